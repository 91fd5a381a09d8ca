"""WARC archives, repair of turns and collocations against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[2])]

from codehealth.llm import itemset_counting, turn_alignment, warc_normaliser  # noqa: E402
from codehealth.llm.queries import QUERIES  # noqa: E402

NEW = ["op11_warc_normaliser", "op12_turn_alignment", "op13_itemset_counting"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- archives ----------------------------------------------------------------------------

PAGES = [(i, f"http://x.org/{i} a\r\n", h) for i, h in enumerate(["a" * 100, None, "", "x" * 99, "a" * 100, "x" * 99, "é" * 50, "b\r\n\r\nWARC/1.1\r\n" * 400, "é" * 50, "a" * 100])]
PAGES += [(None, None, "a" * 100), (None, None, "n" * 200), (None, "u", "n" * 200), PAGES[7], PAGES[7], (70, "", "long " * 400_000)]


def plain_pages(pages):
    out, first = [], {}
    for page, _, html in sorted(pages, key=lambda r: (r[0] is None, r[0])):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        copy = len(body) >= 100 and digest in first
        out.append((page, len(body), digest, "revisit" if copy else "response", first[digest] if copy else None))
        first.setdefault(digest, page)
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder of odd tables, and one of empty tables."""
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, payload string, seq int")
    r = random.Random(5)
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice([None, "", " \n", "Yes.", "yes", "What? ", "a.\x0b", "Long" * 9]), "x", 1)
             for c in range(40) for t in range(r.randrange(9))]
    lost = next(t for t in range(999) if zlib.crc32(f"900:{t}".encode()) % 20 == 0)  # the only turn of its conversation goes
    turns += [(900, lost, "user", "Gone.", "x", 1), (None, None, "user", "Hi.", "x", 1), (None, 3, "assistant", "Ho.", "x", 1), (77, None, "system", "S.", "x", 1), (77, 2, "user", "Q?", "x", 1), turns[3], turns[3],
              *[(500, t, r.choice(["user", "assistant"]), f"Line {r.randrange(900)}" + r.choice([".", "", "!"]), "x", 1) for t in range(700)]]
    conversations = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, kind string, part int")
    texts = [None, "", "...", "A b\tc a B c. a b c", "x" * 3000, *["one two three four five six"] * 9, *["one two\x0bthree four; ONE  two three"] * 9, "five six " * 40, "a. b! " * 30]
    docs = spark.createDataFrame([(i, t, ["en", None, "fr"][i % 3], "s", 1, 2, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n int, k int, phrase string")
    for name, df in {"pages": pages, "conversations": conversations, "documents": docs}.items():
        df.repartition(3).write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", NEW)
def test_empty_tables_give_no_rows(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).collect() == []


def test_pages_come_back_from_their_archives(spark, folders):
    got = rows_of(QUERIES["op11_warc_normaliser"](spark, folders[0]))
    # equal ids of one digest: any of them may be the response
    assert got == plain_pages(PAGES)


def test_archives_are_cut_normalised_and_indexed(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    folder = f"{tmp_path}/warc"
    layout = warc_normaliser.Layout(archive_bytes=3000, archive_records=4)
    written = warc_normaliser.write_monolithic(pages, folder, layout=layout)
    done = warc_normaliser.normalise(written, folder, warc_normaliser.duplicates(written), layout)
    archives = done.collect()
    assert len(archives) >= 4 and all(a["complete"] for a in archives) and sum(a["records"] for a in archives) == len(PAGES)
    index = warc_normaliser.read_index(done).collect()
    assert len(index) == len(PAGES)
    for row in index:  # every record is a gzip member of its own, at its place
        data = Path(row["normalised"]).read_bytes()[row["offset"]:row["offset"] + row["length"]]
        text = zlib.decompress(data, 31)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: " + row["type"].encode()) and row["record_id"].encode() in text
    stored = warc_normaliser.read_records(done).collect()
    html = {p[0]: (p[2] or "").encode() for p in PAGES if p[0] is not None}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in stored if r["record_type"] == "response" and r["page_id"] is not None)
    assert all(r["payload"] is None for r in stored if r["record_type"] == "revisit")
    assert {r["url"] for r in stored} == {None, "", "u", *(f"http://x.org/{i}%20a%0D%0A" for i in range(10))}


def test_damaged_archives_keep_what_comes_before(spark, tmp_path):
    one = b"".join(warc_normaliser.record("response", f"id{i}", i, "u", warc_normaliser.http_head(3) + b"abc", hashlib.sha256(b"abc").hexdigest()) for i in range(3))
    members = b"".join(gzip.compress(x) for x in (one, b"", one))  # several members are read on as one stream
    files = {"whole": gzip.compress(one), "members": members, "cut": gzip.compress(one + random.Random(1).randbytes(5000))[:-3000], "noise": b"\x1f\x8bnothing", "empty": gzip.compress(b"")}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"{tmp_path}/{n}.warc.gz",) for n in files], "archive string")
    done = warc_normaliser.normalise(archives, f"{tmp_path}/out")
    got = {Path(r["archive"]).name.split(".")[0]: (r["records"], r["complete"]) for r in done.collect()}
    assert got == {"whole": (3, True), "members": (6, True), "cut": (3, False), "noise": (0, False), "empty": (0, True)}
    assert sorted(r["page_id"] for r in warc_normaliser.read_records(done).collect()) == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


# ---- turns -------------------------------------------------------------------------------


def plain_repair(turns):
    """(cost, audit, lines) by trying every edit in every state; turns are (role, text, must go, truncated)."""
    @lru_cache(None)
    def best(i, state):
        ends = {"^": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (0, "", ()), "a": (3, "I", ("assistant:",))}
        if i == len(turns):
            return ends[state]
        role, text, gone, cut = turns[i]
        options = []

        def add(cost, letters, lines, nxt):
            c, a, rest = best(i + 1, nxt)
            options.append((cost + c, letters + a, (*lines, *rest)))
        add(4, "D", (), state)
        if not gone:
            for inserted in range(3):
                expects, lines = ("a" if state == "a" else "u"), []
                for _ in range(inserted):
                    lines.append({"u": "user:", "a": "assistant:"}[expects])
                    expects = {"u": "a", "a": "u"}[expects]
                if role[:1] == expects:
                    add(3 * inserted + 3 * cut, "I" * inserted + "K", (*lines, f"{role}:{text}"), "a" if expects == "u" else "u")
                else:
                    add(3 * inserted + 3 + 3 * cut, "I" * inserted + "R", (*lines, f"{dict(u='user', a='assistant')[expects]}:{text}"), "a" if expects == "u" else "u")
            if state == "^" and role[:1] == "s":
                add(3 * cut, "K", (f"{role}:{text}",), "s")
        return min(options)
    return best(0, "^")


def test_a_piece_is_aligned_as_by_trying_everything():
    for n in range(6):
        for letters in itertools.product("sUaxd", repeat=n) if n < 5 else random.Random(2).choices(list(itertools.product("suaxSUAXd", repeat=7)), k=1500):
            turns = [({"s": "system", "u": "user", "a": "assistant"}.get(x.lower(), "x"), "t", x == "d", x.isupper()) for x in letters]
            want = plain_repair(tuple(turns))[:2]
            joined = "".join(letters)
            assert turn_alignment.chain([turn_alignment._aligned(joined, "^")] if joined else []) == want
            half = len(joined) // 2
            if half:  # two pieces are one
                assert turn_alignment.chain([turn_alignment._aligned(joined[:half], "^sua"), turn_alignment._aligned(joined[half:], "^sua")]) == want


def test_the_band_changes_nothing():
    r = random.Random(4)
    for _ in range(40):
        turns = "".join(r.choices("suaUAxd", k=r.randrange(1, 60)))
        wide = turn_alignment._incumbent
        narrow = turn_alignment.align(turns, "^sua")
        turn_alignment._incumbent = lambda *_: 10_000
        try:
            assert turn_alignment.align(turns, "^sua") == narrow
        finally:
            turn_alignment._incumbent = wide


def plain_conversations(rows):
    by, ids = defaultdict(list), {r[0] for r in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv in ids:
        turns = sorted(by[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:16], hashlib.md5(t[2].encode()).digest()))
        seen, marked, faults = set(), [], Counter()
        for _, role, text in turns:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = plain_repair(tuple(marked))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversations_are_repaired_at_least_cost(spark, folders, monkeypatch):
    sys.setrecursionlimit(10_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{folders[0]}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_conversations(rows)
    assert max(len(r[7]) for r in want) > 4 * turn_alignment.PIECE and any("I" in r[7] for r in want) and any(r[7] == "" for r in want)
    assert rows_of(QUERIES["op12_turn_alignment"](spark, folders[0])) == want


# ---- phrases -----------------------------------------------------------------------------


def plain_collocations(docs, p):
    words, counts = Counter(), defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, p.longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {x: a for x, a in f.items() if len(x) > 1 and a >= p.least}
        inside = {x[i:i + n] for x, a in found.items() for n in range(2, len(x)) for i in range(len(x) - n + 1) if 100 * a >= 100 * f[x[i:i + n]]}
        rows = []
        for x, a in found.items():
            if x not in inside:
                score, k = min((p.scale * a * words[lang] // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
                rows.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        out += [(lang, i + 1, x.decode(), -a, left, right, words[lang], -score) for i, (score, a, x, left, right) in enumerate(sorted(rows)[:p.top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("params", [{"least": 2, "shards": 1}, {"least": 9, "shards": 3, "bits": 16, "top": 3}])
def test_collocations_of_odd_texts(spark, folders, params):
    p = itemset_counting.Params(**{"bits": 20, **params})
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], p)
    assert want and rows_of(itemset_counting.collocations(docs, p)) == want


def test_a_full_bit_table_changes_nothing(spark, folders, monkeypatch):
    """With every bit set all phrases are counted at once; the result is the same."""
    import numpy as np
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    p = itemset_counting.Params(least=60, bits=20)
    want = plain_collocations([tuple(r) for r in docs.collect()], p)
    assert want and rows_of(itemset_counting.collocations(docs, p)) == want
    calls = []

    def full(phrases, bits):
        calls.append(1)
        return np.full(1 << bits - 3, 255 if len(calls) < 9 else 0, np.uint8)
    monkeypatch.setattr(itemset_counting, "bit_table", full)
    assert rows_of(itemset_counting.collocations(docs, p)) == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(itemset_counting, "BLOCK", 40)
    texts = ["one two, " * 50, "no separator " * 30, "", "x"]  # cut in bytes
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts)], ["lang", "text"])
    blocks = list(itemset_counting._blocks(iter([batch])))
    assert len(blocks) > 5 and b"".join(t for _, b in blocks for t in b).decode() == "".join(texts)
    assert all(t.rstrip()[-1:] in b",xr" for _, b in blocks for t in b)
