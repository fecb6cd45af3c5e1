"""Token counts by a compiled finite-state transducer whose transitions carry emitted-token counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from causetrace.llm.common import map_text
from causetrace.llm.sentencepieces import ChunkTable

MARK = "▁"
#: Characters of a text that form one block; block maps compose to the map of the text.
BLOCK_CHARS = 1 << 16
#: States before compilation starts afresh (looked at after every piece of so many characters), and words remembered with their counts.
MAX_STATES, PIECE_CHARS, MEMO_WORDS, MEMO_CHARS = 200_000, 1 << 12, 400_000, 64
WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")


#: The state before anything is read.
START = ((0, None, 0),)


@dataclass(frozen=True)
class StateMap:
    """What a block does to any state that comes in: ``head`` is read from it; then, unless ``state`` is None (no word start in the
    block), the transducer is in ``state``, whatever came in, and ``count`` tokens are added: no piece crosses into a marker."""

    head: tuple[str, ...]
    count: int
    state: tuple | None


class CountTransducer:
    """Deterministic transducer of a merge-based (BPE) piece model, compiled as states are met.

    After any prefix the model's segmentation is unique and ends in one piece; a piece may follow
    another exactly if segmenting the two together leaves their border alone. So the last piece and
    the count of a prefix follow from those of the prefixes where a piece can still be open. A
    state is the set of open piece starts: (trie node, last piece before it, its count relative
    to now). Reading a character leads to one state, and the transition carries the change in the
    number of pieces, which may be negative when a longer piece swallows emitted ones.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        self.known = {p for p in scores if len(p) == 1}
        for p in scores:
            node = 0
            for c in p:
                if c not in self.known:
                    raise ValueError(f"{c!r} is in pieces but not a piece")
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = nxt
            self.piece[node] = p
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = [START]
        self.number = {self.states[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.memo: dict[str, int] = {}

    def segment(self, text: str) -> list[str]:
        """The model's own rule on a short string: merge the best-scored neighbours first, leftmost on ties."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str | None, right: str) -> bool:
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            ok = self.pairs[key] = self.segment((left or "") + right) == ([left, right] if left else [right])
        return ok

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Compile one transition: (next state, change in the number of tokens)."""
        if c not in self.known:
            self.next[state][c] = out = (0, len(c.encode("utf-8", "replace")))  # byte fallback; nothing merges with it
            return out
        change = last = None
        opened = []
        for node, before, count in self.states[state]:
            to = self.children[node].get(c)
            if to is None:
                continue
            p = self.piece[to]
            if p is not None and change is None and self.follows(before, p):
                change, last = count + 1, p
            if self.children[to]:
                opened.append((to, before, count))
        new = tuple([(n, b, k - change) for n, b, k in opened] + [(0, last, 0)])
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][c] = out = (at, change)
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(state, count) after reading ``text`` from ``state``."""
        count, table = 0, self.next
        for c in text:
            got = table[state].get(c) or self.step(state, c)
            state = got[0]
            count += got[1]
        return state, count

    def read(self, state: tuple, text: str) -> tuple[tuple, int]:
        """As ``run``, between states given by what they stand for; compilation starts afresh between pieces of text when it has grown too far."""
        count = 0
        for i in range(0, len(text), PIECE_CHARS):
            if len(self.states) > MAX_STATES:
                self._restart()
            at, more = self.run(self._at(state), text[i : i + PIECE_CHARS])
            state, count = self.states[at], count + more
        return state, count

    def _at(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return at

    def word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            n = self.read(START, word)[1]
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = n
        return n

    def block_map(self, block: str) -> StateMap:
        """The state map of a block: what is before its first word start is read from whatever state comes in, the rest once."""
        m = WORD_START.search(block)
        if m is None:
            return StateMap((block,), 0, None)
        words = re.split(f"(?<=[^{MARK}])(?={MARK})", block[m.start() :])
        state, tail = self.read(START, words[-1])
        return StateMap((block[: m.start()],), sum(map(self.word, words[:-1])) + tail, state)

    def apply(self, f: StateMap, state: tuple) -> tuple[tuple, int]:
        """(state, count) after the block of ``f``, entered in ``state``."""
        count = 0
        for part in f.head:
            state, more = self.read(state, part)
            count += more
        return (state if f.state is None else f.state), count + f.count

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring blocks; associative, so blocks may be combined in any grouping."""
        if a.state is None:
            return StateMap(a.head + b.head, b.count, b.state)
        state, more = self.apply(b, a.state)
        return StateMap(a.head, a.count + more, state)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed in pairs, level by level: the up-sweep of a parallel prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.states) > MAX_STATES:
            self._restart()
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= BLOCK_CHARS:
            return sum(map(self.word, re.split(f"(?<=[^{MARK}])(?={MARK})", marked)))
        maps = [self.block_map(marked[i : i + BLOCK_CHARS]) for i in range(0, len(marked), BLOCK_CHARS)]
        return self.apply(self.scan(maps), START)[1]


def piece_scores(model_file: str) -> dict[str, float]:
    """Normal pieces of the model with their merge scores; the model must be of the plain kind handled here."""
    import sentencepiece

    if not ChunkTable(model_file).independent:
        raise ValueError("the model's normaliser does more than mark spaces, or a piece crosses into a marker")
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): sp.get_score(i) for i in ids}


_COMPILED: dict[str, CountTransducer] = {}


def transducer(model_file: str) -> CountTransducer:
    """One transducer for each Python worker and model; its compiled states serve later tasks too."""
    if model_file not in _COMPILED:
        _COMPILED[model_file] = CountTransducer(piece_scores(model_file))
    return _COMPILED[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit), without added tokens.

    A null text counts as empty (0 tokens); rows that repeat are counted each, an empty table gives an empty one. Rows stay where they are: no shuffle. A text is read
    in blocks whose state maps compose, so no step is quadratic in its length.
    """

    def make():
        t = transducer(model_file)

        def f(texts: list) -> dict[str, list]:
            n = [t.count(x or "") for x in texts]
            return {"n_bytes": [len((x or "").encode()) for x in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return f

    return map_text(docs, make, "n_bytes bigint, n_tokens bigint, over_limit boolean")
