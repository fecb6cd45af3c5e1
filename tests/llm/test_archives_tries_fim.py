"""WARC archives, conversation tries and fill-in-the-middle against plain versions of what they compute."""

import base64
import gzip
import hashlib
import io
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from causetrace.llm import fim, prefix_trie, warc

PAGES = "page_id long, url string, html string, archive string, digest string"


def pages_brute(rows):
    groups, out = defaultdict(list), []
    for i, html in rows:
        groups[html or ""].append(i)
    for i, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bytes", [1, 700, 1 << 27])
def test_warc_round_trip(spark, tmp_path, max_bytes):
    rows = [(k, f"http://a/{k}", "<p>" + "x\r\n\r\n" * (k % 4) + "ä" * (k % 3)) for k in range(40)]
    rows += [(41, None, None), (42, "", ""), (None, "http://n", "only"), (None, "u", "<p>"), (50, "bad\r\nWARC-Type: evil b", "WARC/1.1\r\n"), (3, "again", "<p>x\r\n\r\nx\r\n\r\nx\r\n\r\n"), (60, "long", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, "a", "d") for r in rows], PAGES).repartition(3)
    folder = str(tmp_path / "w")
    listed = warc.archive_pages(df, folder, max_bytes=max_bytes)
    index = warc.read_index(listed, folder)
    got = warc.read_records(index, folder).collect()
    told = sorted(((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got), key=str)
    assert told == pages_brute([(i, h) for i, _, h in rows])
    kept = {h or "" for _, _, h in rows}
    assert {r.payload.decode() for r in got if r.record_type == "response"} == kept
    assert all(r.intact for r in got if r.record_type == "response") and not any(r.payload for r in got if r.record_type == "revisit")
    assert {r.uri for r in got if r.page_id == "50"} == {"bad%0D%0AWARC-Type:%20evil%20b"}
    for e in index.collect():  # each member stands alone, and members fill the file
        raw = (tmp_path / "w" / e.archive).read_bytes()
        assert gzip.decompress(raw[e.offset : e.offset + e.length]).startswith(b"WARC/1.1\r\n")
    assert sum(e.length for e in index.collect()) == sum(p.stat().st_size for p in (tmp_path / "w").glob("*.gz"))
    lines = [json.loads(x) for p in (tmp_path / "w").glob("*.idx") for x in p.read_text().splitlines()]
    assert len(lines) == len(rows) and listed.count() >= (len(rows) if max_bytes == 1 else 1)


def test_warc_short_payloads_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.with_types(df, 3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.report(df.limit(0)).collect() == []


def test_split_members_streams(spark):
    head, block = warc._record(7, "u", b"z" * 10, hashlib.sha1(b"z" * 10).hexdigest(), False, None, "2024-01-01T00:00:00Z")
    one = head + block + b"\r\n\r\n"
    for data in (gzip.compress(one * 3), gzip.compress(one) * 3, gzip.compress(one + b"\r\n" + one) + gzip.compress(one)):
        out = io.BytesIO()
        entries = list(warc.split_members(io.BytesIO(data), out, "a"))
        assert [gzip.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) for e in entries] == [one] * 3
    with pytest.raises((ValueError, EOFError)):
        list(warc.split_members(io.BytesIO(gzip.compress(one[:-12])), io.BytesIO(), "a"))
    with pytest.raises((ValueError, EOFError)):
        list(warc.split_members(io.BytesIO(gzip.compress(one * 9)[:-20]), io.BytesIO(), "a"))
    with pytest.raises(ValueError):
        list(warc.split_members(io.BytesIO(gzip.compress(b"no record\r\n")), io.BytesIO(), "a"))


def trie_brute(convs):
    """``convs``: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def told(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def some_conversations(seed, n=120):
    r, own = random.Random(seed), {}
    for c in r.sample(range(200_000), n):
        own[c] = [(r.choice(["u", "a", ""]), r.choice(["", "hi", "hello there", "été", "same"])) for _ in range(r.choice([1, 2, 3, 3, 5, 9]))]
    first = next(iter(own))
    own[first] = own[first] * 40
    for c in range(300_000, 300_000 + 70_000 * 3, 35_000):
        own[c] = [("u", "hot")] * 4
    return own


def rows_of(own, seed=0):
    rows = [(c, i if i else None, role or None, text or None, "x") for c, turns in own.items() for i, (role, text) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string"


def test_trie_whole(spark):
    own = some_conversations(1)
    df = spark.createDataFrame([*rows_of(own), (None, 0, "u", "nobody's", "x")], CONVERSATIONS)
    assert told(prefix_trie.report(df)) == trie_brute(rebuild(own))
    assert prefix_trie.report(df.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 64])
def test_trie_shards_recombine(spark, width):
    own = some_conversations(width)
    seqs = prefix_trie.sequences(spark.createDataFrame(rows_of(own), CONVERSATIONS).repartition(5))
    assert told(prefix_trie.trie(seqs, shard_rows=3, width=width)) == trie_brute(own)


def test_trie_without_turns(spark):
    """Conversations that lose all their turns are members of the root, the only node where there is no other."""
    c = next(x for x in range(1, 999) if x % 5 and zlib.crc32(str(x).encode()) % 9 >= 2)
    df = spark.createDataFrame([(c, 0, "u", "t", "x")], CONVERSATIONS)
    assert told(prefix_trie.report(df)) == trie_brute({c: []})
    assert told(prefix_trie.trie(spark.createDataFrame([(-3, b""), (-4, b"")], "conv_id long, key binary"))) == trie_brute({-3: [], -4: []})


@pytest.mark.parametrize("offsets", [np.array([0]), np.arange(200_000), np.arange(0, 300_000, 7), np.arange(0, 300_000, 40), np.r_[0:9, 70_000:70_003, 200_000:280_000:2, 999_999]])
def test_boundary_set_selects(offsets):
    s = fim.BoundarySet(offsets)
    ks = range(len(offsets)) if len(offsets) < 1000 else random.Random(3).sample(range(len(offsets)), 500)
    assert len(s) == len(offsets) and all(s.select(k) == offsets[k] for k in ks)


def test_boundary_set_takes_every_container():
    s = fim.BoundarySet(np.r_[0:9, 70_000, 70_005, 70_011, 131_072 : 131_072 + 60_000 : 2])
    assert [type(c).__name__ for c in s.containers] == ["_Runs", "_Array", "_Bitmap"]


def fim_brute(doc_id, text, unit="line", fim_share=100, spm_share=50, seed=7):
    import re

    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= fim_share:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_share:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,fim_share,spm_share", [("line", 100, 50), ("char", 100, 50), ("line", 60, 0), ("char", 50, 100)])
def test_fim_cuts_and_restores(spark, unit, fim_share, spm_share):
    r = random.Random(5)
    texts = ["", None, "\n", "\n\n\n", "no line feed", "a\r\nb c\n", "<P>", "x<S>\ny", "<M>", "<\n<\nP>\n", "a<S\n>b", "\U0001f600\né\n" * 40_000, "\n" * 70_000, "z" * 200_000]
    texts += ["".join(r.choice(["a", "\n", "<", "P>", "\U0001f4a9", " "]) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(k, t, "f", "o") for k, t in enumerate(texts)] + [(None, "null\nid\n", "f", "o"), (3, "again\nagain", "f", "o"), (3, "again\nagain", "f", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)
    got = fim.transform(df, unit, fim_share, spm_share)
    key = lambda x: (str(x[0]), x[-1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((fim_brute(i, t, unit, fim_share, spm_share) for i, t, *_ in rows), key=key)
    back = got.select("doc_id", fim.restored(got.output, got.form).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert got.limit(0).count() == 0 and fim.report(df.limit(0)).collect() == []
