"""The registered queries of the corpus operators, each over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, conversations, decontaminate, html_text, html_training, kneser_ney, langid, linedup, mixing, phrases, simhash, token_store, toxicity
from .common import crc_mod, read


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_tokens(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(spark, docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, logp = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), langs, logp)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "lang_set", "lang_shares")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(crc_mod(F.col("doc_id"), 5) != 1), order=3)
    held_out = (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out")
    return kneser_ney.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), html_training.trained_field())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), shards=64).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = linedup.marked_lines(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid(read(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.repaired_digest(conversations.repair(conversations.damage(rows)))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(read(spark, sf_dir, "documents"), a, b)


QUERIES = {f.__name__: f for f in (op1_token_store, op2_toxicity, op3_language, op4_language_model, op5_main_text, op6_mixing, op7_simhash, op8_line_dedup, op9_decontamination, op10_nearest, op11_substring_dedup, op12_conversation_repair, op13_token_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run

_SHINGLES = r"""
  SELECT DISTINCT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                   WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table})"""

ORACLES = {
    "op9_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS item_size FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_size, count(*) / item_size AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_size HAVING count(*) >= 0.8 * item_size""",
}
ORACLES["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h
  FROM d WHERE len(w) >= 35),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p + unnest(range(0, 35)) AS p FROM windows SEMI JOIN often USING (h)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
def _repair_sql() -> str:
    """SQL of op12: crc32 bit by bit, then a recursion over a conversation's rows that keeps the least (cost, audit, text) of
    each of the four states: nothing yet, after system, after user, after assistant."""
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def best(*x):
        return f"list_min([{', '.join(x)}])"

    def add(s, cost, edit, line=""):
        more = f" || chr(10) || {line}" if line else ""
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t{more}}}"

    def put(s, role):
        return add(s, 5, "I", f"'{role}:'")

    def keep(s, role):
        kept = add(s, "extra", "K", "role || ':' || text")
        return f"CASE WHEN NOT gone AND role[1] = '{role}' THEN {kept} ELSE {none} END"

    def turn(s, role):
        turned = add(s, "1 + extra", "R", f"'{role}:' || text")
        return f"CASE WHEN NOT gone THEN {turned} ELSE {none} END"

    def drop(s):
        return add(s, 2, "D")

    users = [f"s{k}" for k in (0, 1, 3)]  # after these a user is due
    two = best("s2", *(put(s, "user") for s in users))
    three = best("s3", put("s2", "assistant"))
    inserted = f"SELECT * REPLACE ({three} AS s3) FROM (SELECT * REPLACE ({two} AS s2) FROM walk)"
    step = f"""SELECT conv, k, {drop('s0')} AS s0, {best(drop('s1'), keep('s0', 's'))} AS s1,
  {best(drop('s2'), *(keep(s, 'u') for s in users), *(turn(s, 'user') for s in users))} AS s2,
  {best(drop('s3'), keep('s2', 'a'), turn('s2', 'assistant'))} AS s3"""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    start = "{'c': 0, 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE raw AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS hit FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM hit)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
lines AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST) > 1 AS again, right(rtrim(text, {space}), 1) AS tail
  FROM hurt h JOIN ids i ON h.conv_id IS NOT DISTINCT FROM i.conv_id),
judged AS (SELECT *, tail = '' AS blank, tail <> '' AND again AS duplicate, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS truncated,
  lead(role[1]) OVER (PARTITION BY conv ORDER BY k) AS next FROM lines),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (next IS NOT NULL AND role[1] || next NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM judged GROUP BY conv),
walk AS (SELECT conv, CAST(0 AS BIGINT) AS k, {start} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM facts
  UNION ALL {step} FROM (SELECT w.* REPLACE (j.k AS k), j.role, j.text, j.blank OR j.duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS extra
    FROM ({inserted}) w JOIN judged j ON j.conv = w.conv AND j.k = w.k + 1)),
done AS (SELECT w.conv, {best('s0', 's3')} AS r FROM ({inserted}) w JOIN facts f ON f.conv = w.conv AND f.n = w.k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(r.c, 0) AS BIGINT) AS cost, coalesce(r.a, '') AS audit, sha256(coalesce(substr(r.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (conv) LEFT JOIN done USING (conv)"""


ORACLES["op12_conversation_repair"] = _repair_sql()
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
