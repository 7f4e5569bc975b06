"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outboxlake.llm import chat, crosspolytope, decontaminate, jaccard, labelled, mixing, phrases, quality, ranked, secrets, suffixes, toxicity, transducer, warc
from outboxlake.llm.store import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = labelled.held_out(F.col("doc_id"), toxicity.PARTS, toxicity.PART)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mixed(table(spark, sf_dir, "documents"), mixing.target_weights(spark))
    return chosen.select("doc_id", "domain", "lang", "source", "tokens", "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = labelled.held_out(F.col("doc_id"), quality.PARTS, quality.PART)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal(table(spark, sf_dir, "conversations"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_classes(table(spark, sf_dir, "documents"))


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    path = vocabulary_path or public_tokenizers.path("word_bpe_49k.json")
    return transducer.digest(transducer.encoded(table(spark, sf_dir, "documents"), path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_chat_snapshots": op5_chat_snapshots,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_archives": op8_archives,
    "op9_secrets": op9_secrets,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_bpe": op13_bpe,
}

OP5_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
named AS (
  SELECT conv_id, row_number() OVER w AS k, coalesce(role, chr(2)) || chr(1) || coalesce(text, chr(2)) || chr(3) AS item,
    '<|im_start|>' || regexp_replace(coalesce(role, 'unknown'), '[<|>\\s]+', ' ', 'g') || chr(10)
      || regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10) AS shown
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
prefixes AS (
  SELECT conv_id, k, string_agg(item, '') OVER w AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM named WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
best AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE k = n_turns GROUP BY ALL),
texts AS (SELECT conv_id, string_agg(shown, '' ORDER BY k) AS text FROM named GROUP BY conv_id)
SELECT conv_id, n_turns, n_copies, text FROM best JOIN texts USING (conv_id)
WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE k < n_turns)
"""

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, doc_id, {_TERMS} FROM d),
sizes AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM w),
lengths AS (SELECT r, doc_id, 75 + CAST(25 * count(*) * any_value(n_docs) AS BIGINT) // CAST(any_value(n_terms) AS BIGINT) AS m FROM w, sizes GROUP BY ALL),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM items) GROUP BY ALL),
tfs AS (SELECT r, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tfs, sizes GROUP BY term),
scores AS (SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest([array_to_string(ws[i:i + 1], ' ') FOR i IN range(1, len(ws))]) FROM lists
  UNION ALL SELECT lang, 3, unnest([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) FROM lists
  UNION ALL SELECT lang, 4, unnest([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) FROM lists) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM grams WHERE f >= 30),
cuts AS (SELECT o.lang, o.phrase, o.k, o.f AS a, c.cut, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * o.f) // (h.f + t.f) AS BIGINT) AS score
  FROM often o JOIN range(1, 4) c(cut) ON c.cut < o.k
  JOIN often h ON h.lang = o.lang AND h.phrase = array_to_string(o.ws[1:c.cut], ' ')
  JOIN often t ON t.lang = o.lang AND t.phrase = array_to_string(o.ws[c.cut + 1:o.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, k, ws, unnest(range(1, k + 1)) AS i FROM often WHERE k >= 3) x, range(2, 4) s(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside n USING (lang, phrase) WHERE n.longer IS NULL OR 100 * n.longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op5_chat_snapshots": OP5_SQL, "op11_ranked_search": OP11_SQL, "op12_collocations": OP12_SQL}
