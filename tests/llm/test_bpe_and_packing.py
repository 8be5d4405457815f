import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.rank_file()), reason="no rank file")


def brute(piece: bytes, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), min_size=1, max_size=40))
def test_tree_merges_like_brute_force(s):
    e = bpe.Encoder.of(bpe.rank_file())
    assert bpe.merge(s.encode(), e.ranks) == (brute(s.encode(), e.ranks) if s.encode() not in e.ranks else [e.ranks[s.encode()]])


def test_like_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.Encoder.of(bpe.rank_file())
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for s in ["", "Hello  world\n\n", "<|endoftext|> it's", "先读残卷，再论明镜。" * 50, "a" * 5000, "🙂é\u0301 \x07\x1b[0m"]:
        assert e.encode(s) == other.encode_ordinary(s)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hi", 0), (2, None, 0), (3, "", 0), (1, "hi", 1)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    assert rows[0] == rows[1] and rows[2:] == [(2, []), (3, [])]
    assert bpe.encode(df.limit(0)).count() == 0


def pieces(spark, sizes, capacity, windows=8, parts=1):
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long").repartition(parts)
    return packing.pack(df, "k", "n", capacity, windows).collect()


def test_nothing_is_lost_or_over_full(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, rng.randrange(100), rng.randrange(400), 100]) for _ in range(3000)]
    rows = pieces(spark, sizes, 100, parts=5)
    by, used = {}, {}
    for r in rows:
        by.setdefault(r.k, []).append((r.piece, r.start, r.n))
        used[r.container_id] = used.get(r.container_id, 0) + r.n
    for k, size in enumerate(sizes):
        cuts = sorted(by[k])
        assert [p for p, _, _ in cuts] == list(range(len(cuts))) and sum(n for _, _, n in cuts) == size
        assert all(n == 100 for _, _, n in cuts[:-1]) and (len(cuts) == 1 or size > 100)
    assert max(used.values()) <= 100
    assert sum(sizes) / (100 * len(used)) > 0.95


def test_edges(spark):
    assert pieces(spark, [], 10) == []
    assert {r.n for r in pieces(spark, [0, None, 0], 10)} == {0}
    assert len({r.container_id for r in pieces(spark, [10, 10, 10], 10)}) == 3
    assert [r.n for r in sorted(pieces(spark, [25], 10), key=lambda r: r.piece)] == [10, 10, 5]


def test_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = pieces(spark, [3] * 200, 10, parts=8)
    used = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n
    assert sum(used.values()) == 600 and max(used.values()) <= 10 and len(used) <= 72


def test_leftovers_of_any_number_of_partitions_are_bounded(spark, monkeypatch):
    seen = []
    merge = packing._merge_round

    def watched(open_, parts, digits, capacity, windows):
        seen.append((parts, open_.groupBy((open_.window / 2**digits).cast("long")).count().agg({"count": "max"}).first()[0]))
        return merge(open_, parts, digits, capacity, windows)

    monkeypatch.setattr(packing, "_merge_round", watched)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = random.Random(5)
    sizes = [rng.randrange(52, 60) for _ in range(3000)]  # no two fit together, so every window stays open
    rows = pieces(spark, sizes, 100, windows=8, parts=40)
    assert [p for p, _ in seen] == [10, 3, 1] and max(n for _, n in seen) <= 4 * 8
    assert len(rows) == 3000 == len({r.container_id for r in rows})
