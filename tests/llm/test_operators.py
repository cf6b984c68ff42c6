"""Operators of the optional part against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import (
    attention_model, decontaminate, language_id, line_dedup, lm_scoring, near_copies, pii, quality, queries, sentencepieces, simhash, suffix_dedup, token_counts)
from riskloom.llm.components import components
from riskloom.llm.words import split_words, string_buffers
from tests.conftest import SMALL
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_split_words():
    words, counts = split_words(pa.array([" A\x0b b\n", "", "x", "\t "]), lower=True)
    assert words.to_pylist() == ["a", "b", "x"] and counts.tolist() == [2, 0, 1, 0]


# --- line dedup ---

def lines_left(rows):
    seen, out = {}, {}
    keyed = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    order = sorted(keyed, key=lambda k: (k[0], k[1]))
    for key in order:
        lines = key[2].split("\n")
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p:p + 3]), (key, p))
    for key in order:
        lines = key[2].split("\n")
        gone = {p + k for p in range(len(lines) - 2) for k in range(3) if seen[tuple(lines[p:p + 3])] != (key, p)}
        out[key] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_line_dedup(request, table):
    df = request.getfixturevalue(table)
    want = lines_left(pairs(df))
    done = line_dedup.line_dedup(df)
    assert done.columns == df.columns
    got = sorted(str((i, t or "")) for i, t in pairs(done))
    assert got == sorted(str((i, want[(i is not None, i or 0, t or "")])) for i, t in pairs(df))


# --- quality rules ---

def test_quality_counts(odd):
    for r in quality.quality_report(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        words, text = WORD.findall(r["text"] or ""), r["text"] or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_rule_order_keeps_verdicts(docs):
    measured = quality.order_rules(docs)
    one = docs.select(quality.cascade(F.col("text"), measured).isNull().alias("a"), quality.cascade(F.col("text"), measured[::-1]).isNull().alias("b"))
    assert one.where("a <> b").count() == 0
    assert [m.gain for m in measured] == sorted((m.gain for m in measured), reverse=True)


def test_rule_sample_is_written_once(spark, tmp_path, monkeypatch):
    drawn = []
    monkeypatch.setattr(quality, "shared_dir", lambda _, name: drawn.append(str(tmp_path / f"{name}-{len(drawn)}")) or drawn[-1])
    docs = spark.createDataFrame([(i, "w " * (5 if i % 2 else 40)) for i in range(400)], "doc_id long, text string")
    measured = quality.order_rules(docs, sample_rows=100)
    assert len(drawn) == 1 and 0 < spark.read.parquet(drawn[0]).count() < 400
    assert {m.rule.name for m in measured} == {r.name for r in quality.RULES}
    assert 0.3 < next(m.rejected for m in measured if m.rule.name == "few_words") < 0.7


# --- benchmark decontamination ---

def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "A b C d e f"), (2, "one"), (None, "ab ab ab ab ab ab"), (4, None), (5, ""), (6, "a b c d e f")], "item_id long, text string")
    got = {(r["doc_id"], r["n_items"], r["item_ids"]) for r in decontaminate.contamination_report(odd, bench).where("contaminated").collect()}
    assert got == {(3, 1, "2"), (4, 2, "1,6"), (11, 1, "-1")}
    assert {r["doc_id"] for r in decontaminate.decontaminate(odd, bench).collect()} == {i for i, _ in ODD} - {3, 4, 11}


# --- simhash ---

def fingerprint(text):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows, distance=4):
    prints = sorted({fingerprint(t) for _, t in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        if i is not None:
            r = find(fingerprint(t))
            low[r] = min(low.get(r, i), i)
    return [(i, f"{fingerprint(t):016x}", low.get(find(fingerprint(t)))) for i, t in rows]


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    found = simhash.simhash_components(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, grouped(pairs(df))))


def test_groups_that_share_an_id_each_keep_a_row(spark):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (5, c), (5, d), (3, c + " "), (5, d), (None, d)]
    for text in (a, b, c, d):
        assert all(text == other or bin(fingerprint(text) ^ fingerprint(other)).count("1") > 4 for other in (a, b, c, d))
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", a), ("None", b), ("3", c + " "), ("5", d)])


def test_near_copies_against_all_pairs(spark):
    """Copies with words replaced, in groups of different closeness: kept ids by exact similarity of all pairs."""
    rng, rows = random.Random(7), []
    for n in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            for _ in range(max(1, round(len(words) * rng.choice((0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05))))):
                copy[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({" ".join(w[i:i + 5]) for i in range(len(w) - 4)})
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    far = [p for p in links if bin(fingerprint(rows[p[0]][1]) ^ fingerprint(rows[p[1]][1])).count("1") > 4]
    root = list(range(len(rows)))
    for a, b in links:
        if root[a] == root[b]:
            continue
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert len(far) > len(links) / 4
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_near_copies_of_a_dense_group(spark):
    """One large group whose members are mostly below the similarity that links: share of the exact links that are kept together."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(220)]
    rows = []
    for n in range(700):
        copy = list(words)
        for _ in range(rng.choice((2, 4, 6, 8, 10))):
            copy[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((n, " ".join(copy)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = near_copies.stored(near_copies.signatures(docs, "doc_id", "text"), "test-signatures")
    nodes = near_copies.stored(prints.select("node", F.struct(F.lit(False).alias("last"), "doc_id", "digest").alias("low"), "size", "keys", "parts").dropDuplicates(["node"]), "test-nodes")
    root = {r["low"]["doc_id"]: r["root"] for r in near_copies.similar_nodes(nodes, docs, "doc_id", "text").collect()}
    together = sum(root[a] == root[b] for a, b in links)
    print("links", len(links), "of", len(rows) * (len(rows) - 1) // 2, "kept", together / len(links))
    assert len(links) > 1000 and together >= 0.9 * len(links)


def test_links_by_one_bit_in_a_segment(spark):
    near = [0, 0b1111, 1 << 22 | 1 << 43 | 1, (1 << 63) - 1, (1 << 63) - 2, 0xF0F0F0F0F0F, 0xF0F0F0F0F0F ^ (1 << 3 | 1 << 30 | 1 << 50 | 1 << 60)]
    got = {r["fp"]: r["root"] for r in simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in near], "fp long")).collect()}
    assert got[near[1]] == got[near[2]] == got[0] and got[near[3]] == got[near[4]] and got[near[5]] == got[near[6]]
    assert len(set(got.values())) == 3


def test_components(spark):
    links = spark.createDataFrame([(a, a + 1) for a in range(0, 40) if a != 20] + [(5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {n: 0 if n <= 20 else 21 for n in range(41)}


# --- repeated strings ---

def without_repeats(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + least] for r in raw for i in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = {i + k for i in range(len(r) - least + 1) if seen[r[i:i + least]] > 1 for k in range(least)}
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(r), len(gone), runs, bytes(b for i, b in enumerate(r) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [1, 2000])
@pytest.mark.parametrize("table", ["odd", "docs"])
def test_suffix_dedup(request, table, hot):
    df = request.getfixturevalue(table)
    got = suffix_dedup.suffix_dedup(df, hot=hot).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    rows = pairs(df)
    want = [(i, *w) for (i, _), w in zip(rows, without_repeats([t for _, t in rows], 400))]
    assert sorted(str((r[0], r[1], r[2], r[3], bytes(r[4]))) for r in got) == sorted(map(str, want))


# --- pieces and token counts ---

def test_sentencepieces(odd):
    done = sentencepieces.sentencepieces(odd)
    for r in done.collect():
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)
    assert set(odd.columns) <= set(done.columns)


def test_viterbi():
    v = sentencepieces.load_pieces()
    ids = {bytes(v.raw[v.offsets[i]:v.offsets[i + 1]]): int(i) for i in v.ids}
    for text in [t for _, t in ODD if t and len(t) < 200]:
        marked = " " + text
        best, back = [0.0] + [-math.inf] * len(marked), [None] * (len(marked) + 1)
        for s in range(len(marked)):
            for e in range(s + 1, min(len(marked), s + 48) + 1):
                piece = ids.get(marked[s:e].encode())
                if piece is not None and best[s] + v.scores[piece] > best[e]:
                    best[e], back[e] = best[s] + v.scores[piece], (s, [piece])
            if marked[s].encode() not in ids and best[s] + v.unknown > best[s + 1]:
                best[s + 1], back[s + 1] = best[s] + v.unknown, (s, [int(v.byte_ids[b]) for b in marked[s].encode()])
        want, e = [], len(marked)
        while e:
            e, part = back[e]
            want = part + want
        assert sentencepieces.encode_texts(pa.array([text]), v)[0].tolist() == want


def test_expected_piece_counts():
    """Forward-backward against the list of all segmentations."""
    v = sentencepieces.load_pieces()
    ids = {bytes(v.raw[v.offsets[i]:v.offsets[i + 1]]): int(i) for i in v.ids}
    chunks = pa.array([b" the", b" government", "  x龘é".encode()], pa.binary())
    n = np.array([3, 1, 2])
    v = sentencepieces.with_counts(v, sentencepieces.substring_counts(*string_buffers(chunks), n, v))

    def ways(text):
        if not text:
            return [[]]
        pieces = [(ids.get(text[:e].encode()), e) for e in range(1, len(text) + 1)]
        return [[p, *rest] for p, e in [(p, e) for p, e in pieces if p is not None or (e == 1 and pieces[0][0] is None)] for rest in ways(text[e:])]

    want = Counter()
    for chunk, times in zip(chunks.to_pylist(), n):
        found = ways(chunk.decode())
        weights = [math.exp(sum(v.unknown if p is None else v.scores[p] for p in way)) for way in found]
        for way, weight in zip(found, weights):
            for p in way:
                want[p] += times * weight / sum(weights)
    got = sentencepieces.expected_counts(*string_buffers(chunks), n, v)
    del want[None]
    assert {int(i): got[i] for i in np.flatnonzero(got)} == pytest.approx(dict(want), abs=1e-9)


def test_frequent_words_are_pieces(spark):
    """Scores are log probabilities of the texts' pieces: words that are pieces of the file come out whole, not as pairs of low rank."""
    words = "the government understanding information possible question children".split()
    rows = [(n, " ".join(words[n % 7:] + words[:n % 7])) for n in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_pieces"] == len(words) and -100 < r["log_score"] < 0 for r in sentencepieces.sentencepieces(texts).collect())
    v = sentencepieces.estimated(texts, sentencepieces.load_pieces())
    assert math.isclose(np.exp(v.scores[v.ids]).sum(), 1, abs_tol=1e-4)


def test_token_counts(odd, docs):
    initial, inside = map(set, token_counts.word_pieces())

    def greedy(word):
        raw, at, n = word.encode(), 0, 0
        while at < len(raw):
            end = next((e for e in range(min(len(raw), at + 64), at, -1) if raw[at:e] in (inside if at else initial)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    for df in (odd, docs):
        for r in token_counts.token_counts(df).collect():
            counts = [greedy(w) for w in WORD.findall(r["text"] or "")]
            assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(max(c, 1) for c in counts), counts.count(0))


def test_automaton_failures():
    a = token_counts.build_automaton([b"a", b"abcdx"], [b"b", b"c", b"cdy", b"dz"])
    words = pa.array(["abcdz", "abcdx", "abcdy", "ab", "q", "abcd"])
    assert token_counts.count_pieces(*string_buffers(words), a).tolist() == [4, 1, 3, 2, 0, 0]


# --- language ---

def test_language(spark, odd):
    rows = queries.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    model = language_id.train(["the cat sat"] * 20 + ["der hund lag"] * 20, ["en"] * 20 + ["de"] * 20)
    for r in language_id.identify(odd, model).collect():
        lettered = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert r["lang_pred"] in (("en", "de") if lettered else ("und",))
    none = language_id.identify(odd, language_id.train_on(odd.limit(0))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


# --- personal data ---

KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def fixed_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = ["a@b.co_x@y.z a@b.c.d. @x.y a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111 5",
        "+1 (523) 555-1055 190.137.223.204 +12 +1--------", "é4111111111111111😀+49 30 1234567", "1" * 5000, "+" * 500, "a." * 2000 + "@b.c"]


def test_pii(spark, odd, docs):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for df in (odd, docs, hard):
        by_row = {str((r["doc_id"], r["base_sha256"])): r for r in pii.pii_report(df).collect()}
        for i, text in pairs(df):
            base = fixed_spans(text)
            r = by_row[str((i, hashlib.sha256(",".join(base).encode()).hexdigest()))]
            assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])
            assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(s.startswith(k) for s in base) for k, _ in KINDS]


# --- language model ---

def test_lm_scores(spark):
    rows = pairs(spark.read.parquet(f"{SMALL}/documents.parquet"))
    tokens = {i: [*WORD.findall(lowered(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = queries.op1_lm_scoring(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r["score"] < 0


def test_model_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(1)
    model = attention_model.train(rng.integers(0, attention_model.LEAVES, (50, attention_model.WINDOW + 1)), rng.integers(0, 3, (attention_model.LEAVES + 1, attention_model.LEAVES)).astype(float), 3)
    text = rng.integers(0, attention_model.LEAVES, 70)
    texts = np.concatenate([np.append(text, x) for x in range(attention_model.LEAVES)])
    logs = attention_model.score(model, texts, np.full(attention_model.LEAVES, 71)).reshape(-1, 71)
    assert np.exp(logs[:, -1]).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(logs[:, :70], logs[0, :70], atol=1e-4)  # nothing depends on what follows


def test_lm_odd_rows(odd):
    got = lm_scoring.lm_scores(odd, F.lit(True), steps=3).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(1 + len(WORD.findall(t or "")) for _, t in ODD)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


# --- all of them ---

def test_empty_tables(odd):
    none = odd.limit(0)
    assert line_dedup.line_dedup(none).count() == quality.quality_filter(none).count() == suffix_dedup.suffix_dedup(none).count() == 0
    assert simhash.simhash_dedup(none).count() == pii.pii_report(none).count() == sentencepieces.sentencepieces(none).count() == 0
    assert decontaminate.decontaminate(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == token_counts.token_counts(none).count() == 0
    assert lm_scoring.lm_scores(none, F.lit(True), steps=2).count() == 0


def test_pipeline(spark):
    """Each stage against plain Python, on the rows the stage before left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    rows = [(i, t) for i, t in pairs(docs) if i in kept]
    left = lines_left(rows)
    rows = sorted((i, left[(True, i, t)]) for i, t in rows)
    rows = [(i, t) for i, t in rows if WORD.search(t)]

    def shingles(text):
        w = WORD.findall(text.lower())
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))  # rows ascend by id
    for a in range(len(rows)):
        for b in range(a):
            if low[a] != low[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                one, other = sorted((low[a], low[b]))
                low = [one if x == other else x for x in low]
    rows = [r for n, r in enumerate(rows) if low[n] == n]
    items = [s for s in map(shingles, bench) if s]
    rows = [(i, t) for i, t in rows if not any(10 * len(shingles(t) & s) >= 8 * len(s) for s in items)]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) for r in got)


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0 and done.count() <= docs.count()
