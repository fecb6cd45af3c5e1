"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from causetrace.llm.common import map_text

MARK = "▁"
#: A marked word: its white-space markers, then everything up to the next marker.
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries that a task's table holds before it starts afresh, and the longest word that enters it.
TABLE_ROWS, TABLE_CHARS = 400_000, 64


class ChunkTable:
    """Ids and decoded bytes of marked words, each segmented by the library once.

    Exact when no piece crosses into a marker from the left and the normaliser only escapes spaces
    and adds the leading one; ``independent`` says so, and otherwise whole texts go to the library.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        probe = "  a Ａ b\t"
        self.independent = not any(MARK in p.lstrip(MARK) for p in pieces) and "".join(
            self._text(p) for p in self.sp.encode(probe, out_type=str)
        ) == " " + probe.replace("Ａ ", self._text_of_bytes(self.sp.encode("Ａ ", out_type=str)))
        self.bos, self.eos = self._u32([self.sp.bos_id()]), self._u32([self.sp.eos_id()])
        self.raw = [self._raw(i, p) for i, p in enumerate(pieces)]
        self.table: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def _u32(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    @staticmethod
    def _text(piece: str) -> str:
        return chr(int(piece[3:5], 16)) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(MARK, " ")

    @staticmethod
    def _text_of_bytes(pieces: list[str]) -> str:
        return "".join(ChunkTable._text(p) for p in pieces).removeprefix(" ")

    def _raw(self, i: int, piece: str) -> bytes:
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.sp.is_control(i) else piece.replace(MARK, " ").encode()

    def _segment(self, word: str) -> tuple[bytes, bytes]:
        # the library drops an empty input, so a lone marker is looked up
        ids = self.sp.encode(word[1:].replace(MARK, " ")) if len(word) > 1 else [self.sp.piece_to_id(MARK)]
        return self._u32(ids), b"".join(map(self.raw.__getitem__, ids))

    def __getitem__(self, word: str) -> tuple[bytes, bytes]:
        got = self.table.get(word)
        if got is None:
            got = self._segment(word)
            if len(word) <= TABLE_CHARS:
                if len(self.table) >= TABLE_ROWS:
                    self.table.clear()
                self.table[word] = got
        return got

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if not text:
            return self.bos + self.eos, b""
        if not self.independent:
            ids = self.sp.encode(text, add_bos=True, add_eos=True)
            return self._u32(ids), self.sp.decode(ids).encode()
        parts = [self[w] for w in MARKED.findall(MARK + text.replace(" ", MARK))]
        return b"".join([self.bos, *[p[0] for p in parts], self.eos]), b"".join([p[1] for p in parts])[1:]


def encode_decode(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text: ``keep`` columns, ``ids_le`` and ``decoded`` (both binary).

    A null text counts as empty: begin and end only. Words are segmented once for each task's table,
    which is cleared when full, so memory is bounded whatever the vocabulary; there is no shuffle.
    """

    def make():
        table = ChunkTable(model_file)

        def f(texts: list) -> dict[str, list]:
            got = [table.encode(t or "") for t in texts]
            return {"ids_le": [g[0] for g in got], "decoded": [g[1] for g in got]}

        return f

    return map_text(docs, make, "ids_le binary, decoded binary", keep=keep)


def digests(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document ``n_tokens, ids_sha256, decoded_sha256`` of ``encode_decode``; the id lists stay inside the task.

    One row for each row of ``docs``; a null text counts as empty, columns but ``keep`` go. An empty table gives an empty one.
    """

    def make():
        table = ChunkTable(model_file)

        def f(texts: list) -> dict[str, list]:
            got = [table.encode(t or "") for t in texts]
            return {
                "n_tokens": [len(g[0]) // 4 for g in got],
                "ids_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got],
                "decoded_sha256": [hashlib.sha256(g[1]).hexdigest() for g in got],
            }

        return f

    return map_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep=keep)
