"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_path
from .common import crc_text, source
from .conversations import repair, repair_report
from .decontaminate import contaminated
from .katz import katz_scores
from .neardup import near_duplicates
from .packing import pack
from .quality import quality_scores, train
from .secretscan import BASE, MORE, secret_spans
from .substrings import remove_repeats
from .tokenfile import read_tokens, write_tokens
from .tokens import token_counts
from .vectors import near_vectors
from .warc import read_archives, write_archives
from .whitening import whitened

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(source(spark, folder, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_katz(spark: SparkSession, folder: str) -> DataFrame:
    return katz_scores(source(spark, folder, "documents", "doc_id", "text"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(source(spark, folder, "documents", "doc_id", "text"), BYTE_BPE)


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(source(spark, folder, "documents", "doc_id", "text"), 3, (85, 100))


def op5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(source(spark, folder, "embeddings", "vec_id", "embedding", "label"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(source(spark, folder, "documents", "doc_id", "text"), WORD_BPE)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(source(spark, folder, "documents", "doc_id", "text"), source(spark, folder, "benchmark", "item_id", "text"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = source(spark, folder, "documents", "doc_id", "text")
    return quality_scores(docs, train(docs, source(spark, folder, "labels", "doc_id", "quality")))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(source(spark, folder, "documents", "doc_id", "text"), path, BYTE_BPE)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(source(spark, folder, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the contract of op11 sets; nulls in a row's name, role and text are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = crc_text(F.concat(named[0], F.lit(":"), named[1])) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = source(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    found = repair_report(repair(damaged(rows)))
    none = F.sha2(F.lit("").cast("binary"), 256)
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256")
    )


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(source(spark, folder, "documents", "doc_id", "text"))
    kinds = [rule.kind for rule in BASE]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return found.select(
        "doc_id", *map(number, kinds), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """``deviation`` is null where it is beyond the range of long; the operator has it as a decimal."""
    found = whitened(source(spark, folder, "embeddings", "vec_id", "embedding"))
    return found.select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


QUERIES = {
    "op1_warc": op1_warc,
    "op2_katz": op2_katz,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op5_vectors": op5_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversations": op11_conversations,
    "op12_secrets": op12_secrets,
    "op13_whitening": op13_whitening,
}

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, h.digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest AND n >= 100
"""

OP7 = """
WITH words AS (
  SELECT false AS item, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT true, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
widths AS (SELECT DISTINCT least(5, len(w)) AS width FROM words WHERE item AND len(w) > 0),
s AS (
  SELECT DISTINCT item, id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM words JOIN widths
    ON CASE WHEN item THEN width = least(5, len(w)) ELSE width <= len(w) END)),
n AS (SELECT id, count(*) AS n FROM s WHERE item GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM s i JOIN s d ON i.item AND NOT d.item AND i.width = d.width AND i.s = d.s JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN root ON root.a = vec_id
"""



def _either_case(pattern: str) -> str:
    """A pattern with each letter outside of classes and escapes in either case, and no others that fold to it."""
    return re.sub(r"(\[[^\]]*\]|\\x..|\\.)|([a-zA-Z])", lambda m: m[1] or f"[{m[2].upper()}{m[2].lower()}]", pattern)


def _secrets_sql() -> str:
    rules = []
    for place, rule in enumerate(BASE + MORE):
        pattern = (_either_case(rule.pattern) if rule.fold else rule.pattern).replace("'", "\'\'")
        rules.append(f"SELECT {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, row, "
                     f"regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gaps, "
                     f"list_transform(regexp_extract_all(t, '{pattern}'), lambda x: regexp_extract(x, '{pattern}', {rule.group})) AS g FROM d")
    union = "\n  UNION ALL ".join(rules)
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({union}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT row, place, kind, length(array_to_string(gaps[:i], '')) + length(array_to_string(m[:i - 1], '')) AS s, length(m[i]) AS n
  FROM each WHERE length(g[i]) >= least)
SELECT any_value(doc_id) AS doc_id, {count},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row
"""


def _conversations_sql() -> str:
    """From the end of a conversation: for each state the least (cost, audit) and the lines that it leaves."""

    def edit(letter: str, cost: str, rest: str, line: str | None = None) -> str:
        lines = f"{rest}.p" if line is None else f"{line} || chr(10) || {rest}.p"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'p': {lines}}}"

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    roles, target, whole = ("user", "user", "assistant", "user"), (2, 2, 3, 2), "r || ':' || t"
    kept = [[("s", 1), ("u", 2)], [("u", 2)], [("a", 3)], [("u", 2)]]
    turn = []
    for q in range(4):
        rerole = edit("R", "3 + 3 * cut", f"s{target[q]}", f"'{roles[q]}:' || t")
        keep = [edit("K", f"CASE WHEN left(r, 1) = '{i}' THEN 3 * cut ELSE 1000000 END", f"s{to}", whole) for i, to in kept[q]]
        stay = best(edit("D", "4", f"s{q}"), rerole, *keep)
        turn.append(f"CASE WHEN gone THEN {edit('D', '4', f's{q}')} ELSE {stay} END AS w{q}")
    x2, x3 = best("w2", edit("I", "3", "w3", "'assistant:'")), best("w3", edit("I", "3", "w2", "'user:'"))
    x0, x1 = (best(w, edit("I", "3", "x2", "'user:'")) for w in ("w0", "w1"))
    nothing = "{'c': 0::BIGINT, 'a': '', 'p': ''}"
    return f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS name
  FROM conversations),
faulty AS (
  SELECT conv_id, turn, r, named.t, xor(list_reduce(list_prepend(4294967295, name),
    lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM named, t),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE r END AS r,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS i FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, r, t ORDER BY i) > 1 AS seen,
    lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(r, 1) AS pair FROM placed),
judged AS (
  SELECT *, blank OR seen AS gone,
    (NOT (blank OR seen) AND NOT regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*\\z'))::BIGINT AS cut FROM marked),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, sum(cut)::BIGINT AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, n + 1 AS i, {nothing} AS s0,
    {{'c': 6::BIGINT, 'a': 'II', 'p': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s1,
    {{'c': 3::BIGINT, 'a': 'I', 'p': 'assistant:' || chr(10)}} AS s2, {nothing} AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, i, {x0} AS s0, {x1} AS s1, x2 AS s2, x3 AS s3 FROM (
    SELECT *, {x2} AS x2, {x3} AS x3 FROM (
      SELECT walk.conv_id, judged.i, {', '.join(turn)}
      FROM walk JOIN judged ON walk.conv_id IS NOT DISTINCT FROM judged.conv_id AND judged.i = walk.i - 1))),
found AS (SELECT counted.*, s0 FROM counted JOIN walk ON counted.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(left(s0.p, greatest(length(s0.p) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN found ON e.conv_id IS NOT DISTINCT FROM found.conv_id
"""


SQL: dict[str, str] = {
    "op1_warc": OP1, "op5_vectors": OP5, "op7_decontamination": OP7,
    "op11_conversations": _conversations_sql(), "op12_secrets": _secrets_sql(),
}
