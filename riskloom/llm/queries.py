"""One query per dealt operator over its whole table, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    decontaminate, filter_audit, language_id, line_dedup, lm_scoring, merkle, pii, quality, reply_trees, sentencepieces, simhash, suffix_dedup, token_counts)
from riskloom.llm.tables import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = lm_scoring.lm_scores(docs, language_id.fold(F.col("doc_id"), 5) != 1)
    return done.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold(F.col("doc_id"), 3) == 1
    model = language_id.train_on(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = sentencepieces.sentencepieces(docs)
    return done.select("doc_id", "ids", "n_pieces", "n_byte_pieces", "log_score", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(_table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.suffix_dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)
),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, i + x AS i FROM f, (SELECT unnest([0, 1, 2]) AS x) WHERE k > 1),
parts AS (SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
kept AS (
  SELECT p.doc_id, p.n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS rest
  FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id, p.n_lines
)
SELECT doc_id, n_lines, n_removed, sha256(rest) AS kept_sha256 FROM kept
"""


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(_table(spark, folder, "documents"))


OP8_COUNTS = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i:i + 7] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
n AS (SELECT doc_id, count(DISTINCT i + x) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS x) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{L}')) AS n_letters
  FROM t LEFT JOIN n ON t.doc_id = n.doc_id
),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
         OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_letters < word_chars AS rule_failed
  FROM c
)
"""

OP8_SQL = f"""
WITH {OP8_COUNTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM v
"""


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, list_filter(regexp_split_to_array(lower(text), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL GROUP BY text),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
leak AS (SELECT doc_id, item_id, found / n AS share FROM hit JOIN size USING (item_id) WHERE 10 * found >= 8 * n),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(share) AS containment FROM leak GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, round(coalesce(containment, 0.0), 6) AS containment,
       n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN per USING (doc_id)
"""


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_components(_table(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


CONTROL_TALK = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TALK).alias("text"))
    chains = stored(reply_trees.as_chains(rows.unionByName(added)), "chat-chains")
    done = reply_trees.format_trees(chains)
    read = done.select("tree", "formatted", reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.loss_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *,
    length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(SYS|INST|OUT|ROLE)\]')) AS escaped_chars,
    length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(SYS|INST|OUT|ROLE)\]')) AS role_chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(escaped_chars + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 19 + role_chars END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
d AS (SELECT part, good, toxic, concat(CASE WHEN fails.A THEN 'A' END, CASE WHEN fails.B THEN 'B' END, CASE WHEN fails.C THEN 'C' END, CASE WHEN fails.D THEN 'D' END, CASE WHEN fails.E THEN 'E' END) AS failed FROM f),
cell AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, failed),
perm AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM perm, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
),
step AS (SELECT filter_order, k AS step, filter_order[k] AS letter, filter_order[1:k - 1] AS before FROM perm, (SELECT unnest(range(1, 6)) AS k) WHERE length(filter_order) = 5),
o AS (
  SELECT part, filter_order, step, letter, n, good, toxic, failed = letter AS lone, contains(failed, letter) AS hit,
         before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone
  FROM step, cell
),
m AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (lone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM o GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM m
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.row_digest(*changed))
    manifest = merkle.build_manifest(docs, carry={"tampered": tampered})
    found = merkle.proofs(manifest)
    folded = merkle.fold(F.coalesce("tampered", "node"), F.col("segments"))
    root = F.lit(manifest.root).cast("string")
    proved = found.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", root.alias("root"), merkle.proof_digest(F.col("segments")).alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """Level by level: t<k> are the nodes, s<k> the runs of a level, f<k> the leaves on their way up.  A lone node passes unchanged."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(parts) + ")"

    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    parts = [f"""
d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents),
t0 AS (SELECT lang, leaf AS node, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS w,
              doc_id, tampered FROM d)"""]
    climb = "(w + 7) // 8 AS w, r // 8 AS r, CASE WHEN w > 1 THEN sha256({0}) ELSE {1} END AS {2}"
    total = levels + top_levels
    for k in range(total):
        group = "lang" if k < levels else "1"
        if k == levels:
            parts.append(f"t{k} AS (SELECT 1 AS lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS w, lang AS name FROM u)")
        parts.append(f"s{k} AS (SELECT {group} AS lang, r // 8 AS run, list(node ORDER BY r) AS nodes FROM t{k} GROUP BY {group}, r // 8)")
        if k not in (levels - 1, total - 1):
            parts.append(f"t{k + 1} AS (SELECT {group} AS lang, {climb.format('string_agg(node, $$$$ ORDER BY r)', 'min(node)', 'node')} FROM t{k} GROUP BY {group}, r // 8, w)")
        elif k == levels - 1:
            parts.append(f"u AS (SELECT lang, CASE WHEN any_value(w) > 1 THEN sha256(string_agg(node, '' ORDER BY r)) ELSE min(node) END AS node FROM t{k} GROUP BY lang)")
        else:
            parts.append(f"v AS (SELECT CASE WHEN any_value(w) > 1 THEN sha256(string_agg(node, '' ORDER BY r)) ELSE min(node) END AS root FROM t{k})")
    parts.append("f0 AS (SELECT doc_id, lang, lang AS name, node AS leaf, coalesce(tampered, node) AS node, r, w, '' AS proof FROM t0)")
    for k in range(total):
        if k == levels:
            parts.append(f"g AS (SELECT f{k}.* REPLACE (1 AS lang, t{k}.r AS r, t{k}.w AS w), t{k}.node AS subroot FROM f{k} JOIN t{k} ON f{k}.name IS NOT DISTINCT FROM t{k}.name)")
        source, extra = ("g", ", subroot") if k == levels else (f"f{k}", ", subroot" if k > levels else "")
        before, after = "array_to_string(nodes[1:r % 8], '')", "array_to_string(nodes[r % 8 + 2:], '')"
        parts.append(f"""f{k + 1} AS (SELECT doc_id, {source}.lang, name, leaf{extra}, {climb.format(f'{before} || node || {after}', 'node', 'node')},
  CASE WHEN w > 1 THEN proof || {before} || {after} ELSE proof END AS proof FROM {source} JOIN s{k} ON {source}.lang IS NOT DISTINCT FROM s{k}.lang AND r // 8 = run)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{total}, v"


OP13_SQL = _merkle_sql()


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_language_id, op3_sentencepiece, op4_token_counts, op5_pii, op6_suffix_dedup, op7_line_dedup, op8_quality_rules, op9_decontamination, op10_simhash,
    op11_chat_formatting, op12_filter_audit, op13_merkle_manifest)}
SQL = {"op7_line_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_decontamination": OP9_SQL,
       "op11_chat_formatting": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
