"""The manifest, the shards and the hard negatives against plain Python, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import common, hard_negatives, merkle, sharding
from strataloom.llm import queries as registered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, kids string, path string, rank int, slot string, size string"


def documents(spark, n, seed=1):
    r = random.Random(seed)
    own = ("g", "k", "p", 1, "s", "z")
    rows = [(i if r.random() < 0.97 else None, r.choice(["a", None, ""]), r.choice(["en", "en", "en", "de", "é", None, ""]), r.choice([None, 5, 70]), r.choice([None, "", "Text %d É" % i, "SAME"]), *own) for i in range(n)]
    rows += [(n + 1, "a", "solo", 1, "alone", *own), (3, "a", "en", 1, "x" * 200_000, *own), *[(4, "b", "de", 1, "copy", *own)] * 3]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


# 11 -----------------------------------------------------------------------------------------------------------------


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def lower_az(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def steps(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        b = i // fanout * fanout
        out.append(("".join(nodes[b:i]), "".join(nodes[i + 1 : b + fanout])))
        i //= fanout
    return out


def expected(rows, fanout=8):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, members in by_lang.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = tree([leaf_of(r) for r in members], fanout)
    crown = tree([trees[lang][-1][0] for lang in langs], fanout)
    root = crown[-1][0]
    out = []
    for g, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            path = steps(trees[lang], i, fanout) + steps(crown, g, fanout)
            start = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                start = leaf_of((*row[:4], lower_az(row[4])))
            for before, behind in path:
                start = H(before + start + behind)
            out.append((row[0], leaf_of(row), trees[lang][-1][0], root, H("".join(a + b for a, b in path)), start, start == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 7, 64, 700])
def test_manifest_by_hand(spark, tmp_path, n):
    rows, docs = documents(spark, n)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_manifest_of_many_groups_and_another_fanout(spark):
    rows = [(i, None, f"l{i % 40:02d}" if i % 3 else "hot", 1, "t", "g", "k", "p", 1, "s", "z") for i in range(300)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3)
    got = found.select("order", merkle.text_of(F.col("leaf")), merkle.text_of(F.col("subroot")), merkle.text_of(F.col("root")), merkle.proof(F.col("path")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r[:5] for r in expected(rows, 3)), key=str)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_manifest_without_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_names_what_differs(spark, tmp_path):
    rows, docs = documents(spark, 60)
    held = merkle.Manifest.write(docs, f"{tmp_path}/m")
    assert held.differing(docs).count() == 0
    other = [(*r[:4], "other", *r[5:]) if r[0] == 7 else r for r in rows if r[0] != 8] + [(1000, "a", "en", 1, "new", *rows[0][5:])]
    changes = {(r.order, r.change) for r in held.differing(spark.createDataFrame(other, SCHEMA)).collect()}
    assert changes == {(7, "changed"), (1000, "new")} | ({(8, "gone")} if any(r[0] == 8 for r in rows) else set())


# 12 -----------------------------------------------------------------------------------------------------------------


def spread(shard_of, load, shards):
    total = [0] * shards
    for s, i in shard_of.items():
        total[i] += load.get(s, 0)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_rebalancing_levels_and_moves_little(seed):
    r = random.Random(seed)
    slots, shards = 400, 7
    load = {s: int(r.lognormvariate(5, 1.5)) for s in range(slots) if r.random() < 0.9}
    now = {s: s % shards for s in range(slots)}
    edits = sharding.balanced(now, load, shards)
    assert all(now[s] != i for s, i in edits.items())
    after = spread(now | edits, load, shards)
    assert sum(after) == sum(load.values())
    assert max(after) - min(after) <= max(min(load.values()), 2) or max(after) == max(load.values())
    over = sum(max(0, t - sum(load.values()) / shards) for t in spread(now, load, shards))
    assert sum(load.get(s, 0) for s in edits) <= 4 * over + max(load.values())
    assert sharding.balanced(now | edits, load, shards) == {} or max(spread(now | edits | sharding.balanced(now | edits, load, shards), load, shards)) <= max(after)


def test_rebalancing_is_as_good_as_any_on_small_maps():
    r = random.Random(3)
    for _ in range(20):
        load = {s: r.randint(1, 30) for s in range(7)}
        got = spread({s: s % 2 for s in load} | sharding.balanced({s: s % 2 for s in load}, load, 2), load, 2)
        best = min(max(spread(dict(zip(load, c, strict=True)), load, 2)) for c in itertools.product(range(2), repeat=7))
        assert max(got) <= best * 1.1 + 1


def test_growing_moves_rows_only_into_the_new_shard():
    r = random.Random(5)
    load = {s: r.randint(1, 500) for s in range(2000)}
    now = {s: s % 9 for s in range(2000)}
    edits = sharding.grown(now, load, 9)
    assert set(edits.values()) == {9}
    after = spread(now | edits, load, 10)
    assert after[9] == pytest.approx(sum(after) / 10, rel=0.02) and max(after) <= max(spread(now, load, 9))
    assert sharding.grown(now, {}, 9) == {}


def test_map_keeps_its_versions(spark, tmp_path):
    rows = sharding.records(documents(spark, 500)[1], 64)
    loads = sharding.slot_loads(rows)
    known = sharding.SlotMap(spark, f"file://{tmp_path}/map", 64).create(4)
    assert (known.rebalance(loads, 4), known.grow(loads, 4)) == (1, 2)
    at = [{r.slot: r.shard for r in known.at(v).collect()} for v in range(3)]
    assert at[0] == {s: s % 4 for s in range(64)} and set(at[2].values()) == {0, 1, 2, 3, 4}
    assert all(at[2][s] in (at[1][s], 4) for s in range(64))
    assert {r.slot: r.shard for r in known.at().collect()} == at[2]
    assert known.edits().where("version = 2").count() == sum(at[1][s] != at[2][s] for s in range(64))
    with pytest.raises(Exception, match="already exists"):
        known._put(2, spark.createDataFrame([], sharding.EDITS))


@pytest.mark.parametrize("n", [0, 40, 900])
def test_shards_of_documents(spark, tmp_path, n):
    rows, docs = documents(spark, n)
    if n == 0:
        rows, docs = [], spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.op12_sharding(spark, str(tmp_path)).collect()
    text = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((r[0], len(text(r[4])) + 8, zlib.crc32(text(r[4]))) for r in rows), key=str)
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
    assert set(held) <= set(range(24))
    for members in held.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})
    if n:
        total = [sum(r.size for r in m) for m in held.values()]
        slot = max(sum(r.size for r in g) for g in [[x for x in got if x.virtual_slot == v] for v in {r.virtual_slot for r in got}])
        assert max(total) <= max(slot, sum(total) / 24 + 100)


# 13 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, rid string, q string, score string"


def vectors(n, dims, seed, labels=4, levels=None):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = r.normal(0, 0.125, dims).astype(np.float32).tolist() if levels is None else r.choice(levels, dims).tolist()
        out.append((i, v, int(r.integers(0, labels)) if i % 3 else 1, "i", "r", "q", "s"))
    odd = [(None, out[0][1], 1), (n + 1, None, 1), (n + 2, out[1][1], None), (n + 3, [None] + out[0][1][1:], 2), (n + 4, [float("nan")] + out[0][1][1:], 2), (n + 5, [float("inf")] + out[0][1][1:], 2), (n + 6, [], 2), (n + 7, out[2][1][:2], 0), (n + 8, [0.0] * dims, 1)]
    return out + [(*x, "i", "r", "q", "s") for x in odd] + [(*out[5][:2], 3, "i", "r", "q", "s")]


def brute(rows, every, positives=5, negatives=5):
    ok = [(i, v, lab) for i, v, lab, *_ in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    q = [np.floor(256.0 * np.array(v, np.float32).astype(float)).astype(int).tolist() for _, v, _ in ok]
    out = []
    for a, (aid, _, alab) in enumerate(ok):
        if aid % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), ok[b][0], b) for b in range(len(ok)) if b != a)
        best = [(s, b) for s, _, b in scored if ok[b][2] == alab][:positives]
        for s, p in best:
            fits = [(-n, ok[b][0]) for n, _, b in scored if ok[b][2] != alab and 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(aid, ok[p][0], k + 1, nid, -s, n) for k, (n, nid) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "levels", "block", "chunk"), [(6, None, 64, 7), (16, None, 4096, 4096), (3, [-0.5, 0.0, 0.25], 50, 10)])
def test_hard_negatives_by_brute_force(spark, dims, levels, block, chunk):
    rows = vectors(400, dims, dims, levels=levels)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("id") % 10 == 0, block=block, chunk=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_registered_hard_negatives(spark, tmp_path):
    rows = vectors(450, 8, 4, labels=10)
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    changed = [(r[0], r[1], (r[2] + 1) % 10 if None not in (r[0], r[2]) and r[0] % 7 == 0 else r[2]) for r in rows]
    assert sorted(map(tuple, registered.op13_hard_negatives(spark, str(tmp_path)).collect())) == brute(changed, 100)


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(10, [], 1, "", "", "", ""), (20, [], 1, "", "", "", ""), (30, [], 2, "", "", "", "")], VECTORS), F.col("id") % 10 == 0).count() == 2  # 30 has no positive


def test_the_threshold_stops_early_and_strictly():
    """On vectors with few large components most rows are never scored; a tie with the kth score is still looked for."""
    r = np.random.default_rng(1)
    m = np.where(r.random((2000, 8)) < 0.1, r.integers(50, 200, (2000, 8)), r.integers(0, 4, (2000, 8))).astype(float)
    lists = np.argsort(m, axis=0, kind="stable").T
    a = np.zeros(8)
    a[[1, 5]] = 3, -2
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                reads.append(len(key))
            return np.asarray(super().__getitem__(key))

    scores = m @ a
    got = hard_negatives.threshold_search(m.view(Counted), lists, a, np.ones(2000, bool), np.arange(2000), [(-np.inf, np.inf)], 5)
    assert got[0].tolist() == np.lexsort((np.arange(2000), -scores))[:5].tolist()
    assert sum(reads) < 1000
    tied = np.zeros((100, 1))
    tied[:60] = 7
    got = hard_negatives.threshold_search(tied, np.argsort(-tied, axis=0, kind="stable").T[:, ::-1], np.ones(1), np.ones(100, bool), np.arange(100)[::-1], [(-np.inf, np.inf)], 5)
    assert sorted(np.arange(100)[::-1][got[0]]) == [40, 41, 42, 43, 44]


def test_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")}
    hard_negatives.mine(spark.createDataFrame(vectors(50, 4, 2), VECTORS), F.col("id") % 10 == 0)
    assert before == {k: spark.conf.get(k, None) for k in before}
    assert common.settings
