"""Chat formatting, filter audit and manifest against brute force, on odd rows and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import attention_model, filter_audit, lm_scoring, merkle, near_copies, queries, reply_trees as rt, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\l\\k\\b", "<s", "<s>", "[INST", "]", "[/ROLE] x", "a\\</s>\\\\[OUT] b", "", None, " \n", "日本 😀 [SYS]", "x" * 70_000]
TREE = "tree long, node long, parent long, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting ---

def test_escapes_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None], "t string")
    for r in df.select("t", rt.escaped(F.col("t")).alias("e"), rt.unescaped(rt.escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?(SYS|INST|OUT|ROLE)\]", r["e"])


def read_back(done):
    turns, learned = rt.read_turns(F.col("formatted")), rt.loss_texts(F.col("formatted"), F.col("loss"))
    return done.select("tree", "place", "branch_score", "formatted", "loss", turns.alias("turns"), learned.alias("learned"))


def test_nasty_conversations(spark):
    roles = ["user", "assistant", "system", "tool", None, "[ROLE] \\x"]
    rows = [(c, t // 2 if t % 5 else None, roles[((c or 0) + t) % len(roles)], NASTY[(3 * (c or 0) + t) % len(NASTY)]) for c in (None, 1, 2, 3) for t in range(15)]
    rows += rows[:4]  # repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit("x"), "node": F.lit(1), "score": F.lit("s")})
    chains = rt.as_chains(df)
    got = {r["tree"]: r for r in read_back(rt.format_trees(chains)).collect()}
    assert set(got) == {None, 1, 2, 3}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[2:] for x in own]
        assert r["learned"] == [x[3] for x in own if x[2] == "assistant"]
        raw = r["formatted"].encode()
        assert [r["formatted"][s["start"]:s["end"]].encode() for s in r["loss"]] == [raw[s["byte_start"]:s["byte_end"]] for s in r["loss"]]


def brute_branches(rows):
    """All root-to-leaf paths of a tree: (score, length, leaf, nodes)."""
    by_id = {r[1]: r for r in rows}
    parents = {r[2] for r in rows if r[2] is not None}
    for r in rows:
        path, seen = [r[1]], {r[1]}
        while by_id[path[-1]][2] in by_id:
            path.append(by_id[path[-1]][2])
            if path[-1] in seen:
                break
            seen.add(path[-1])
        else:
            if r[1] not in parents:
                yield sum(by_id[n][5] for n in path), len(path), r[1], path[::-1]


@pytest.mark.parametrize("keep", [1, 3])
def test_branches_against_brute_force(spark, keep):
    rng, rows = random.Random(5), []
    for tree in range(12):
        for node in range(rng.choice([1, 2, 9, 40])):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else (999 if rng.random() < 0.5 else None)
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), f"t{node}", float(rng.randrange(4))))
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (50, 3, 1, "user", "c", 1.0)]  # a circle and what hangs on it
    rows += [(60, n, n - 1 if n else None, "user", str(n), 0.0) for n in range(130)]
    got = {}
    for r in read_back(rt.format_trees(spark.createDataFrame(rows, TREE), keep)).collect():
        got.setdefault(r["tree"], []).append((r["place"], r["branch_score"], [x["text"] for x in r["turns"]]))
    want = {}
    for tree in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tree]
        best = sorted(brute_branches(own), key=lambda b: (-b[0], -b[1], b[2]))[:keep]
        if best:
            texts = {r[1]: r[4] for r in own}
            want[tree] = [(k + 1, b[0], [texts[n] for n in b[3]]) for k, b in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


# --- filter audit ---

def brute_audit(docs, labels):
    texts, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    for i, q, x in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    found = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > texts.get(t, i)}
        found.append((lang or "", {k for k, v in fails.items() if v}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {f[0] for f in found}:
        own, shapley = [f for f in found if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                alive = [f for f in own if not f[1] & set(order[:k])]
                lost = [f for f in alive if c in f[1]]
                shapley[c] += len(lost)
                out[part, "".join(order), k + 1] = [
                    len(alive) - len(lost), len(lost), sum(c in f[1] for f in own) - len(lost), sum(f[1] == {c} for f in own), sum(f[2] for f in lost), sum(f[3] for f in lost)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_on_odd_rows(spark, odd):
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (13, None, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("en"))
    docs = docs.withColumns({"mask": F.lit("m"), "part": F.lit("p"), "good": F.lit("g")})
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in filter_audit.filter_audit(docs, table).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark, odd):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(odd.limit(0), table).count() == 0
    assert filter_audit.filter_audit(odd, table).groupBy("part").count().where("count <> 600").count() == 0


# --- manifest ---

def climb(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8: at // 8 * 8 + 8]
        out.append((run[:at % 8], run[at % 8 + 1:]))
        at //= 8
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[g]), key=lambda x: x[:3]) for g in order}
    trees = {g: climb([x[2] for x in own[g]]) for g in order}
    tops = climb([trees[g][-1][0] for g in order])
    root, out = tops[-1][0] if rows else None, []
    for k, g in enumerate(order):
        for at, (_, _, digest, row) in enumerate(own[g]):
            path = siblings(trees[g], at) + siblings(tops, k)
            node = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf((*row[:4], None if row[4] is None else re.sub("[A-Z]", lambda m: m.group().lower(), row[4])))
            for before, after in path:
                node = sha("".join(before) + node + "".join(after))
            out.append((row[0], digest, trees[g][-1][0], root, sha("".join(b for x, y in path for b in x + y)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("count, languages", [(0, 1), (1, 1), (8, 1), (9, 1), (200, 3), (700, 12)])
def test_manifest_against_brute_force(spark, tmp_path, count, languages):
    rng = random.Random(count)
    langs = [None, "", "é", *(f"l{i}" for i in range(20))][:languages]
    rows = [(rng.choice([i, i, 5, None]), rng.choice(["s", None]), rng.choice(langs), rng.choice([i, None]), rng.choice(NASTY[:13] + ["ABC " * i])) for i in range(count)]
    rows += rows[: count // 4]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumns({"leaf": F.lit(1), "grp": F.lit("g"), "rank": F.lit(2), "node": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))


def test_proofs_of_some_leaves(spark, docs):
    manifest = merkle.build_manifest(docs)
    some = manifest.leaves.where("id % 7 = 3")
    found = merkle.proofs(manifest, some)
    assert found.count() == some.count() > 0
    assert found.where((F.col("node") != F.col("leaf")) | (merkle.fold(F.col("leaf"), F.col("segments")) != manifest.root)).count() == 0


def test_packed_windows_predict_every_leaf_once():
    lengths = np.array([1, 70, 31, 32, 5])
    leaves = np.arange(lengths.sum())
    rows = attention_model.packed_windows(leaves, lengths)
    targets = rows[:, 1:].ravel()
    assert targets[targets < attention_model.LEAVES].tolist() == leaves.tolist()
    assert attention_model.packed_windows(leaves[:0], lengths[:0]).shape == (0, attention_model.WINDOW + 1)


def test_lm_learns_from_every_training_place(spark, monkeypatch):
    seen, whole = [], lm_scoring.refined
    monkeypatch.setattr(lm_scoring, "refined", lambda *args: (seen.append(whole(*args)), seen[-1])[1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = lm_scoring.lm_scores(docs, F.col("doc_id") % 3 != 0, steps=20).collect()
    assert seen[0][1] == sum(r["n_pieces"] for r in got if r["learned"])


def test_near_copies_without_centres_keep_every_link(spark, monkeypatch):
    """With no round of stars at all, the last pass alone finds what all pairs find, over many parts of a bucket."""
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    monkeypatch.setattr(near_copies, "REST_ROWS", 16)
    rng = random.Random(11)
    words = [f"w{n}" for n in range(220)]
    rows = []
    for n in range(120):
        copy = list(words)
        for _ in range(rng.choice((2, 6, 10, 14))):
            copy[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((n, " ".join(copy)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = near_copies.near_copy_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 1 < len(set(root)) < len(rows) and sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_near_copies_that_share_no_band_are_one_group(spark):
    """Two texts of similarity 0.8 whose MinHash values agree in 42 places, but in no band: candidates by bands alone never meet."""
    import pyarrow as pa

    rng = random.Random(592)
    words = [f"w{n}" for n in range(230)]
    for _ in range(5):
        copy = list(words)
        for k in rng.sample(range(len(words)), 5):
            copy[k] = f"x{rng.randrange(9999)}"
    texts = [" ".join(words), " ".join(copy), " ".join(reversed(words))]
    keys, _ = near_copies._keys(*near_copies._sets(pa.array(texts)))
    a, b = (set(zip(*(t.split()[k:] for k in range(5)))) for t in texts[:2])
    assert 10 * len(a & b) >= 8 * len(a | b) and not (keys[0] == keys[1]).any()
    got = near_copies.near_copy_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


@pytest.mark.parametrize("hi", [0, 1])
def test_last_pass_returns_fewer_links_than_members(hi):
    """Two parts of a bucket return the links that join their groups, not all their pairs, and none that falls short of the similarity."""
    import pyarrow as pa

    close = [sorted({*range(100)} - {n}) for n in range(30)]  # 98 of 100 shared: all pairs are links
    apart = [sorted({*range(1000, 1070)} | {*range(2000 + 30 * n, 2030 + 30 * n)}) for n in range(30)]  # 70 of 130 shared: none is
    sets = close + apart
    n = len(sets)
    members = pa.table({
        "node": pa.array(range(n), pa.int64()), "grp": pa.array(range(n), pa.int64()), "tile": pa.array([k % 2 * hi for k in range(n)], pa.int64()),
        "lo": pa.array([0] * n, pa.int64()), "hi": pa.array([hi] * n, pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})
    a, b = near_copies._links_of(members)
    assert len(a) == len(close) - 1 and (a < b).all() and {*a.tolist(), *b.tolist()} == set(range(len(close)))


def test_lm_gradient_is_that_of_its_loss():
    """Also with scores too far apart for exponents without a shift."""
    rng = np.random.default_rng(3)
    for far in (1.0, 400.0):
        model = attention_model.initial(rng.integers(0, 3, (attention_model.LEAVES + 1, attention_model.LEAVES)).astype(float), rng)
        model.weights = {name: value.astype(np.float64) for name, value in model.weights.items()}
        model.weights["q"] *= far
        rows = rng.integers(0, attention_model.LEAVES + 1, (4, attention_model.WINDOW + 1))
        step = lambda: attention_model._step(model, rows[:, :-1], rows[:, 1:], attention_model._mask())  # noqa: B023, E731
        loss, g = step()
        assert np.isfinite(loss) and set(g) == set(attention_model.TRAINED)
        for name in attention_model.TRAINED if far == 1 else ("o", "in", "class", "member"):
            way = rng.normal(size=model.weights[name].shape)
            model.weights[name] += 1e-3 * way
            up = step()[0]
            model.weights[name] -= 2e-3 * way
            down = step()[0]
            model.weights[name] += 1e-3 * way
            assert (up - down) / 2e-3 == pytest.approx(float((g[name] * way).sum()), rel=0.02, abs=2e-3), name


def test_lm_scores_stay_numbers_when_all_exponents_are_far_below_zero():
    """Before, such a row's exponents were all zero and its logarithm was not finite."""
    rng = np.random.default_rng(4)
    leaves, lengths = rng.integers(0, attention_model.LEAVES, 90), np.array([90])
    model = attention_model.initial(np.ones((attention_model.LEAVES + 1, attention_model.LEAVES)), rng)
    plain = attention_model.score(model.tables(), leaves, lengths)
    model.class_prior = model.class_prior - np.float32(200)  # the same shares of each row
    assert np.allclose(attention_model.score(model, leaves, lengths), plain, atol=1e-3)


def test_lm_splits_each_block_once(spark, monkeypatch):
    """The passes over blocks read the pieces that the blocks hold; before, each split all words again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", (F.col("doc_id") % 3 != 0).alias("learned"), F.coalesce("text", F.lit("")).alias("text"))
    splitter = lm_scoring._splitter(lm_scoring.MODEL)
    for block in lm_scoring.blocks(rows, lm_scoring.MODEL).toArrow().to_batches():
        for k in range(block.num_rows):
            words = block["words"][k].as_py()
            want = [splitter.encode(word) for word in words]
            assert lm_scoring._unpacked(block, k, "sizes").tolist() == [len(w) for w in want]
            assert lm_scoring._unpacked(block, k, "pieces").tolist() == [p for w in want for p in w]


def test_copies_of_one_anchor_stay_spread_over_tasks(spark):
    """Before, all rows of an anchor met in one task of the join."""
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 500).alias("anchor"), "id")
    found = spark.range(0, 400).select(F.col("id").alias("anchor"), (F.col("id") * 2).alias("twice"))
    got = suffix_dedup._joined(rows, found, ["anchor"], found.where("anchor = 7").select("anchor"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(found, "anchor").collect()))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 500


@pytest.mark.parametrize("share", [1, 10**9])
def test_strings_of_copies_and_near_copies(spark, monkeypatch, share):
    """With no frequent key, and with every repeated key a frequent one."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", share)
    rng = random.Random(6)
    text = " ".join(f"{rng.randrange(10**6)}" for _ in range(150))
    texts = [text] * 20 + [text[:n * 40] + f"<{n}>" + text[n * 40:] for n in range(1, 15)] + [str(n) * 90 for n in range(9)] + [None, ""]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "kept").collect()
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k:k + 400] for r in raw for k in range(len(r) - 399))
    for r in got:
        own = raw[r["doc_id"]]
        gone = {k + j for k in range(len(own) - 399) if seen[own[k:k + 400]] > 1 for j in range(400)}
        assert bytes(r["kept"]) == bytes(b for k, b in enumerate(own) if k not in gone)
    assert len(got) == len(texts)
