"""Archives, resampling and ranked search against brute force on small tables with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from ledgerloom.llm import ranking, resampling, warc

CLASHES = "doc_id bigint, text string, n_words string, rank string, score string, row string, id string, buckets string, `a.b` string"
MORE = ("w", "r", "s", "x", "i", "b", "ab")
TEXTS = [None, "", "  .,; ", "One two THREE", "one two three", "Übung macht den Meister übung", "a", " ".join(f"w{k % 97} Stone" for k in range(30_000)), "The quiet river. " * 40, "the QUIET river; " * 40, "x" * 70_000, "é٣ 12 é٣"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = np.array("stone river cloud amber quiet winter garden silver ember north lantern meadow the of and".split())
    texts = TEXTS + [" ".join(words[rng.integers(0, len(words), rng.integers(5, 60))]) for _ in range(150)]
    rows = [(k, t, *MORE) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, "null id of the quiet river", *MORE), (3, "the other three", *MORE)], CLASHES)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The river, the quiet RIVER", "z"), (2, None, "z"), (3, "", "z"), (4, "no such words here", "z"), (5, TEXTS[7][:5000], "z"), (1, "The river, the quiet RIVER", "z"), (None, "stone three", "z"), (7, "übung", "z")]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id string")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def draws_by_force(docs, targets):
    own = [(r.doc_id, *features(r.text)) for r in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in targets for b in features(x)[1])
    s_all, t_all = s.total() + 10000.0, t.total() + 10000.0
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(10000)]
    rows = []
    for doc_id, words, f in own:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def test_resampling(spark, docs, items):
    got = resampling.draws(docs, items)
    want = draws_by_force(docs.collect(), [r.text for r in items.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == want
    assert sum("None)" not in w for w in want) >= 5
    kept = resampling.resample(docs, items)
    assert kept.columns == ["doc_id", "text", "row", "id", "buckets", "a.b", "n_words", "n_features", "weight", "score", "rank"] and kept.count() == docs.count()
    assert {r["a.b"] for r in kept.collect()} == {"ab"}
    assert resampling.draws(docs.limit(0), items).count() == 0
    assert sorted(map(str, map(tuple, resampling.draws(docs, items.limit(0)).collect()))) == draws_by_force(docs.collect(), [])


def test_cut_narrows_to_the_place(spark):
    rng = np.random.default_rng(3)
    values = [*map(int, rng.normal(0, 1e6, 3000)), *[77] * 500, 10**15, -(10**15)]
    scores = spark.createDataFrame([(v,) for v in values], "score bigint")
    down = sorted(values, reverse=True)
    for wanted in (1, 2, 700, 1600, len(values)):
        assert resampling.cut(scores, wanted) == down[wanted - 1]
    assert resampling.cut(scores, 0) is None and resampling.cut(scores.limit(0), 5) is None


def answers_by_force(docs, items, k=50):
    tokens = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(x))
    own = [(r.doc_id, Counter(tokens(r.text))) for r in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, total, df = len(own), sum(c.total() for _, c in own), Counter(t for _, c in own for t in c)
    out = []
    for item in items:
        scores = []
        for d, c in own:
            m = 50 + 50 * c.total() * n_docs // total
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(tokens(item.text)) if t in c), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], math.inf if s[1] is None else s[1]))[:k]
        out += [(item.item_id, i + 1, d, s) for i, (s, d) in enumerate(best)]
    return sorted(map(str, out))


@pytest.mark.parametrize("bounds", [{}, {"POSTINGS": 64, "LEAF": 2, "FANOUT": 2, "FIRST": 3}, {"POSTINGS": 500, "ITEMS": 2, "FIRST": 1}])
def test_ranking(spark, docs, items, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(ranking, name, value)
    got = ranking.answers(docs.repartition(3), items)
    assert sorted(map(str, map(tuple, got.collect()))) == answers_by_force(docs.collect(), items.collect())


def test_ranking_of_nothing(docs, items):
    assert ranking.answers(docs.limit(0), items).count() == 0
    assert ranking.answers(docs, items.limit(0)).count() == 0


def test_search_opens_ties_and_skips_the_rest():
    """Ids fall while places rise, so ties at the last kept score are found in ranges whose bound only equals it; ranges below it stay closed."""
    n = 4096
    doc, term = np.arange(n), np.zeros(n, np.int64)
    impact = np.where((doc >= 1000) & (doc < 1200), 9, 3)
    tree, best = ranking.MaxTree(doc, term, impact, n), ranking.Best(50, 1)
    opened = ranking.search(tree, n - doc, np.array([0]), np.array([True]), best)
    assert sorted(-d for _, d in best.heap) == list(range(n - 1199, n - 1149)) and {s for s, _ in best.heap} == {9}
    assert opened < 16
    assert (ranking.lengths_scaled(np.array([10**9]), 10**12, 10**13) == 50 + 50 * 10**9 * 10**12 // 10**13).all()


PAGES = "page_id bigint, url string, html string, record_type string, error string, key string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h{k % 3}.example/p {k}", f"<html><body><p>{'text of a page ' * (k % 40)}</p></body></html>") for k in range(300)]
    rows += [(400, None, None), (401, "no scheme", ""), (402, "http://x/\r\nWARC-Type: request", "a\r\n\r\nb"), (403, "http://ü/", "ünï 🎉  " * 50_000), (None, "http://n/", "only null id"), (None, "http://n/", "<html><body><p></p></body></html>"), (300, "u", "twin"), (300, "v", "twin"), (299, "w", "twin")]
    return spark.createDataFrame([(*r, "t", "e", "k") for r in rows], PAGES)


def pages_by_force(pages):
    body = lambda r: (r.html or "").encode()
    kept = {}
    for r in pages:
        kept[body(r)] = max(kept.get(body(r), -1), -1 if r.page_id is None else r.page_id)
    out = []
    for r in pages:
        response = (-1 if r.page_id is None else r.page_id) == kept[body(r)]
        out.append((r.page_id, len(body(r)), base64.b32encode(hashlib.sha1(body(r)).digest()).decode(), "response" if response else "revisit", None if response else kept[body(r)], None))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [8 << 20, 5000])
def test_warc(spark, pages, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE", size)
    assert sorted(map(str, map(tuple, warc.archived(pages).collect()))) == pages_by_force(pages.collect())
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_files_and_payloads(spark, pages, tmp_path):
    kept = warc.write(pages)
    assert warc.export(kept, f"file://{tmp_path}/out").count() == kept.count()
    records = warc.read(warc.from_files(spark, f"file://{tmp_path}/out/*.warc.zst"))
    found = warc.resolved(records).collect()
    assert Counter(bytes(r.payload) for r in found) == Counter((r.html or "").encode() for r in pages.collect())
    assert {r.target_uri for r in found if r.record_id == "urn:ledgerloom:page:402"} == {"http://x/%0D%0AWARC-Type:%20request"}
    info = records.where("record_type = 'warcinfo'").collect()
    assert len(info) == kept.count() and all(r.error is None for r in found + info)


def test_warc_frames_are_plain_zstandard(spark, pages):
    """Another reader's view: the skippable frame holds the dictionary; the library decodes the frames one after the other with it."""
    for r in warc.write(pages).collect():
        data = bytes(r.content)
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D
        end = 8 + int.from_bytes(data[4:8], "little")
        held, rest, n = zstandard.ZstdDecompressor().decompress(data[8:end]), data[end:], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = one.unused_data, n + 1
        assert n == sum(1 for _ in warc.records_in("a", data, True))


def test_warc_tells_damage(spark):
    good = [warc.page_record(k, f"http://e/{k}", b"payload %d" % k * 20, True, None, warc.DATE) for k in range(3)]
    trained = warc.dictionary([])
    whole = warc.archive(good, trained)
    errors = lambda data: [r["error"] for r in warc.records_in("a", data, True)]
    assert errors(whole) == [None] * 3 and errors(b"") == errors(None) == []
    assert errors(whole[:-3])[:2] == [None, None] and "ends within" in errors(whole[:-3])[2]
    assert errors(b"junk" * 5) == ["no frame where one should start"]
    flipped = bytearray(whole)
    flipped[-10] ^= 1
    assert errors(bytes(flipped))[:2] == [None, None] and errors(bytes(flipped))[2]
    plain = lambda *records: errors(b"".join(zstandard.ZstdCompressor().compress(r) for r in records))
    assert plain(*good) == [None] * 3  # no dictionary frame: frames without a dictionary
    assert "without warc-date" in plain(good[0].replace(b"WARC-Date", b"X-Date"))[0]
    assert "version" in plain(good[0].replace(b"WARC/1.1", b"WARC/9.9", 1))[0]
    assert "isn't as long" in plain(good[0] + b"more")[0] and "isn't as long" in plain(good[0][:-9])[0]
    assert "block digest" in plain(good[0].replace(b"payload 0", b"payload X"))[0]
    assert "unknown type" in plain(good[0].replace(b"response", b"surprise", 1))[0]
    assert "content length" in plain(re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: -1\r\n\r\nHTTP", good[0]))[0]
    assert plain(b"no record", good[1]) == ["a record without an end of its header", None]
    folded = good[0].replace(b"WARC-Type: response", b"warc-type:\r\n response")
    assert plain(folded) == [None]
    rows = warc.read(spark.createDataFrame([("a", whole), ("b", None), ("c", b"xx")], "name string, content binary")).collect()
    assert Counter(r.archive for r in rows) == {"a": 3, "c": 1}
