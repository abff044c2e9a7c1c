"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexgrove.llm import chat, collocations, compact_windows, decontaminate, fingerprints, langid, lexical, line_dedup, minhash, packing, pii, simhash, token_counts
from lexgrove.llm.common import load


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of the session; without one the query has a key of its own, so that its results can be compared."""
    key = spark.conf.get("spark.lexgrove.pseudonym.key", "no secret")
    return pii.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, digests read back from the formatted text."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, :control AS text FROM range(2)", {"control": control})
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat.format_conversations(turns)
    read = chat.read_back(done.select("conv_id", "formatted", "spans", "rewrites"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(load(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii_pseudonyms, op2_chat_format, op3_document_fingerprints, op4_simhash_near_dedup, op5_token_counts, op6_benchmark_decontamination, op7_line_dedup, op8_substring_dedup, op9_packing, op10_language_id, op11_ranked_search, op12_phrase_collocations, op13_minhash_near_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op7_line_dedup": f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, g AS line, ls[g] AS s FROM (SELECT *, unnest(generate_series(1, len(ls))) AS g FROM raw)),
seqs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM lines WHERE trim(s) <> ''),
wins AS (
  SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM seqs WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
later AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, seq) > 1 AND length(s) >= {line_dedup.MIN_LINE_CHARS} AS single,
         s2 IS NOT NULL AND row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id, seq) > 1 AS run FROM wins),
gone AS (
  SELECT doc_id, line, single OR bool_or(run) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM later),
rest AS (
  SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE NOT coalesce(g.gone, false)) AS text,
         count(g.line)::BIGINT AS n_lines, count(*) FILTER (WHERE g.gone)::BIGINT AS n_removed
  FROM lines l LEFT JOIN gone g USING (doc_id, line) GROUP BY 1)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS text_sha256 FROM rest""",
    "op11_ranked_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, nn),
s AS (
  SELECT item_id, f.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n.n * nn) // ll)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n ON n.doc_id = f.doc_id, c GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op12_phrase_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
sizes AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY 1),
g AS (
  SELECT lang, ws[i : i + k - 1] AS p, count(*)::HUGEINT AS f
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k) GROUP BY 1, 2),
cand AS (SELECT * FROM g WHERE len(p) > 1 AND f >= 100),
inner_ AS (
  SELECT DISTINCT c.lang, c.p[i : i + k - 1] AS p, c.f FROM cand c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS k) WHERE k < len(c.p) AND i + k - 1 <= len(c.p)),
gone AS (SELECT DISTINCT c.lang, c.p FROM cand c JOIN inner_ x ON x.lang = c.lang AND x.p = c.p AND 100 * x.f >= 100 * c.f),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, s.n, k, x.f AS l, y.f AS r, (1000 * c.f * s.n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM cand ANTI JOIN gone USING (lang, p)) c
  JOIN sizes s ON s.lang = c.lang JOIN g x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1 : len(c.p)]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
said AS (SELECT *, array_to_string(p, ' ') AS phrase FROM low)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM said QUALIFY rank <= 2000""",
}
