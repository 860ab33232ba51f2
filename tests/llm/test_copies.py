"""Operators 2, 4 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import bayes_join, exact_dedup, repeats
from tallgrass.llm.anchors import anchors
from tallgrass.llm.bayes_join import drop_near_copies, least_matches, shingle_sets, similar
from tallgrass.llm.common import likely
from tallgrass.llm.components import components
from tallgrass.llm.exact_dedup import drop_copies, exact_groups
from tallgrass.llm.ngrams import word_hashes
from tallgrass.llm.repeats import RunIndex, range_minima, remove_repeats

LENGTH = 400


def marked(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[k : k + LENGTH]) for b in raw for k in range(len(b) - LENGTH + 1))
    out = []
    for b in raw:
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - LENGTH + 1):
            if seen[hash(b[k : k + LENGTH])] > 1:
                edge[k] += 1
                edge[k + LENGTH] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_repeats(table, rows):
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(table(rows)).collect())
    assert got == sorted(((i or 0), *m) for (i, _), m in zip(rows, marked([t for _, t in rows]), strict=True))


def test_repeats(table, rows):
    check_repeats(table, rows)
    assert remove_repeats(table([])).count() == 0


def test_repeats_of_many_alike(table, words, monkeypatch):
    """A hot passage in many contexts, blocks, batches of one group, overlaps and periods."""
    monkeypatch.setattr(repeats, "BLOCK", 4)
    monkeypatch.setattr(repeats, "BATCH", 16)
    passage = " ".join(words(110, 3))
    rows = [(k, " ".join(words(20 + k % 5, k)) + passage[k % 40 :] + " ".join(words(25, 300 + k))) for k in range(24)]
    rows += [(50, "ab" * 700), (51, "ab" * 250 + "c" + "ba" * 250), (52, ("z" * 150 + "y") * 6), (53, passage[:399]), (54, passage[:401] + "q")]
    check_repeats(table, rows)


def test_a_hot_passage_in_thousands_of_contexts(table):
    """Two passages, one just long enough to go and one just too short, in 5,000 contexts each."""
    r = random.Random(11)
    letters = lambda n: "".join(r.choices("abcdefgh ", k=n))
    long, short = letters(404), letters(399)
    check_repeats(table, [(k, letters(40) + (long if k % 2 else short) + letters(40)) for k in range(10_000)])


def test_anchors_of_equal_strings_are_equal():
    r = np.random.default_rng(1)
    shared = r.integers(97, 105, 420).astype(np.uint8)
    texts = [np.concatenate([r.integers(97, 105, n).astype(np.uint8), shared, r.integers(97, 105, m).astype(np.uint8)]) for n, m in ((50, 900), (700, 3))]
    found = [set(zip((a[0] - n).tolist(), a[1].tolist(), strict=True)) for a, n in zip(map(anchors, texts), (50, 700), strict=True)]
    assert any(0 <= at <= 420 - 128 for at, _ in found[0] & found[1])


def test_range_minima():
    values = np.array([5, 3, 8, 1, 9, 2])
    first, last = np.array([0, 2, 4, 5, 0]), np.array([1, 2, 5, 5, 5])
    assert range_minima(values, first, last).tolist() == [3, 8, 2, 2, 1]


def test_matching_on_small_windows(monkeypatch):
    monkeypatch.setattr(repeats, "SIDE", 4)
    monkeypatch.setattr(repeats, "LENGTH", 6)
    monkeypatch.setattr(repeats, "GRAM", 2)
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 9)
        sides = np.array([[r.choice([1, 1, 1, 2]) for _ in range(8)] for _ in range(n)])
        group = np.array([r.randint(0, 1) for _ in range(n)])
        whole = np.concatenate([sides[:, :4], np.zeros((n, 2), int), sides[:, 4:]], 1)
        want = [[any(j != i and group[i] == group[j] and (whole[i, s : s + 6] == whole[j, s : s + 6]).all() for j in range(n)) for s in range(5)] for i in range(n)]
        assert RunIndex(sides, group).marks().tolist() == want


def test_exact_groups(table, rows):
    docs = table(rows)
    for digest, batch in ((None, 100), (lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2)), 1)):
        got = exact_groups(docs, **({"digest": digest} if digest else {}), files_per_batch=batch).collect()
        assert len(got) == len(rows)
        by = {}
        for i, t in rows:
            by.setdefault(t or "", []).append(i)
        for t, members in by.items():
            own = [r for r in got if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
            keep = max((i for i in members if i is not None), default=None)
            assert sorted((r["doc_id"] or 0) for r in own) == sorted((i or 0) for i in members)
            assert {(r["keep_id"], r["group_size"]) for r in own} == {(keep, len(members))}
            assert sum(r["kept"] for r in own) == 1
    assert exact_groups(table([])).count() == 0


def test_drop_copies(table, rows):
    for own in (table(rows), table(rows).withColumns({"path": F.lit("x"), "row": F.lit(1), "file": F.lit(2), "_metadata": F.lit(0)})):
        got = drop_copies(own)
        assert got.columns == own.columns
        assert sorted((r["doc_id"] or 0) for r in got.collect()) == sorted({t or "": max((i or 0) for i, u in rows if (u or "") == (t or "")) for _, t in rows}.values())


def test_two_arrivals(table, tmp_path):
    """State outlives a call; hits with earlier rows are read from their files."""
    first = [(1, "a"), (5, "b"), (6, "b"), (None, None)]
    second = [(2, "a"), (4, "b"), (7, "c"), (8, "")]
    short = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 0))  # noqa: E731  all digests meet
    for k, digest in enumerate((exact_dedup.sha256, short)):
        found = []
        for n, own in enumerate((first, second)):
            path = str(tmp_path / f"rows {k}{n}")
            table(own).write.parquet(path)
            docs = table(own).sparkSession.read.parquet(path)
            found.append(sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs, digest, state=str(tmp_path / f"state{k}")).collect())))
        assert found[0] == [(0, None, 1, True), (1, 1, 1, True), (5, 6, 2, False), (6, 6, 2, True)]
        assert found[1] == [(2, 2, 2, True), (4, 6, 3, False), (7, 7, 1, True), (8, 8, 2, True)]


def test_only_texts_of_hits_are_compared(table):
    docs = table([(k, f"text {k % 90}") for k in range(100)])
    hashed = docs.withColumn("digest", exact_dedup.sha256(F.col("text")))
    hits = hashed.groupBy("digest").count().where("count > 1").select("digest")
    found = lambda keys: likely(hashed, ["digest"], keys, "hit").where("hit").count()
    assert found(hits) == 20 and found(hits.limit(0)) == 0


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 10 * n >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda k: (rows[k][0] is None, rows[k][0], k))
                root[y] = x
    return sorted(((i, rows[find(k)][0], links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def check_links(table, rows):
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in similar(table(rows)).collect()), key=repr) == brute_links(rows)


def around(base, n, first, changes=6):
    """``n`` versions of a text with some words changed: pairs on both sides of the threshold."""
    out = []
    for k in range(n):
        w = list(base)
        for c in range(k % changes):
            w[(k * 13 + c * 29) % len(w)] = f"w{k}"
        out.append((first + k, " ".join(w)))
    return out


def test_similar(table, rows, words, monkeypatch):
    monkeypatch.setattr(bayes_join, "BLOCK", 8)
    near = around(words(200, 9), 40, 200)
    # identifiers that several texts share, a class of null identifiers, and one with a null among others
    odd = [(7, "quite another text " * 3), (6, near[2][1]), (None, near[3][1]), (None, " ".join(words(70, 31))), (None, " ".join(words(70, 31)) + " end"), (None, None)]
    check_links(table, [*rows, *near, *odd])
    assert similar(table([])).count() == 0


def test_similar_around_a_hub_and_along_a_chain(table, words, monkeypatch):
    """Boilerplate ties the texts of a chain by bands, and most of its pairs are not alike."""
    monkeypatch.setattr(bayes_join, "BLOCK", 4)
    plate = words(120, 5)
    chain = [(k, " ".join(plate[k : k + 60] + words(40, 700 + k))) for k in range(0, 60, 2)]
    slide = words(400, 6)
    chain += [(1000 + k, " ".join(slide[4 * k : 4 * k + 80])) for k in range(70)]
    base = words(100, 8)
    hub = [(2000, " ".join(base))] + [(2001 + k, " ".join(base[: 80 - k % 3] + words(15, 900 + k))) for k in range(30)]
    check_links(table, chain + hub)


def test_texts_and_shingles_are_not_staged(table, monkeypatch):
    """What op2 stages takes a small part of the texts' room, also where all texts have links."""
    r, stage, size = random.Random(3), bayes_join.staged, Counter()

    def counted(df, name, last=False):
        out = stage(df, name, last)
        size[name] += sum(Path(url2pathname(urlparse(f).path)).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(bayes_join, "staged", counted)
    rows = [(2 * k, " ".join(f"{r.getrandbits(32):08x}" for _ in range(2000))) for k in range(40)]
    rows += [(k + 1, f"{t} end") for k, t in rows]
    assert {x["n_links"] for x in similar(table(rows)).collect()} == {1}
    assert 0 < sum(size.values()) < 0.2 * sum(len(t) for _, t in rows), size


def test_classes_of_many_meetings(table, words, monkeypatch):
    monkeypatch.setattr(bayes_join, "BLOCK", 4)
    monkeypatch.setattr(bayes_join, "MEETINGS", 2)
    near = around(words(150, 12), 40, 0, 4)
    check_links(table, near + near[:5])


def test_rows_that_change_between_reads(table, words):
    text = " ".join(words(80, 13))
    other = F.udf(lambda t: f"{t} {random.SystemRandom().random()}").asNondeterministic()
    with pytest.raises(Exception, match="not the same"):
        similar(table([(k, text) for k in range(4)]).withColumn("text", other("text"))).count()


def test_recall_on_documents(spark):
    """All links of an exact join over the table are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids, sets = list(text), list(shingle_sets(pa.array(list(text.values()))))
    holders = {}
    for k, s in enumerate(sets):
        for g in s.tolist():
            holders.setdefault(g, []).append(k)
    shared = Counter((a, b) for own in holders.values() if len(own) > 1 for n, b in enumerate(own) for a in own[:n])
    links = Counter()
    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            links.update((ids[a], ids[b]))
    assert sum(links.values()) > 150
    assert {r["doc_id"]: r["n_links"] for r in similar(docs).where("n_links > 0").collect()} == dict(links)


def test_drop_near_copies(table, rows, words):
    clash = rows + [(7, " ".join(words(50, 41)))]  # the identifier of a near copy, another text
    got = drop_near_copies(table(clash).withColumn("set_id", F.lit(1)))
    assert got.columns == [*table([]).columns, "set_id"]
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert Counter(i for i, _ in left)[7] == 1 and clash[-1] in left
    ids = [i for i, _ in left]
    assert 6 in ids and 8 not in ids and 5 not in ids and {1, 2, 3, 4, 9, 11} <= set(ids) and None in ids
    again = drop_near_copies(table([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None)]))
    assert sorted(((r["doc_id"], r["text"]) for r in again.collect()), key=repr) == [(5, "a b c d e f"), (None, None), (None, None)]


def test_pruning_keeps_what_can_reach_the_threshold():
    least = least_matches()
    assert all(0 < m < n * 0.8 for n, m in least.items())
    assert least_matches(0.8, 1e-3)[200] > least[200]


def test_shingles_and_words():
    import pyarrow as pa

    s = list(shingle_sets(pa.array(["a b c d e f", "a b c d e", "a b", "", "b a", "a\tb\nc  d\x0be"])))
    assert [len(x) for x in s] == [2, 1, 1, 0, 1, 1]
    assert (s[1] == s[5]).all() and s[1][0] in s[0] and s[2][0] != s[4][0]
    data = "xy".encode()
    assert len(word_hashes(np.frombuffer(data, np.uint8), np.array([0, 1, 2]))[0]) == 2


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_chain(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(n + 1)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
