"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import chat_format, collocations, decontaminate, divergence, labels, language_id, license_scan, line_dedup, packing, quality_rank, quality_rules, shared, simhash_dedup, toxicity, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), labels.crc_mod("doc_id", 5) == 0
    rows = labels.sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out, most_rows=20_000)
    return toxicity.score(docs, toxicity.train(rows)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), grams=True)
    return out.select("doc_id", "n_lines", "n_removed_lines", "text")


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), labels.crc_mod("doc_id", 4) == 2
    rows = labels.sample(docs, table(spark, sf_dir, "labels"), "quality", ~held_out, most_rows=20_000)
    return quality_rank.score(docs, quality_rank.train(rows)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = found.select("doc_id", F.explode(F.arrays_zip("items", "scores", "question_overlaps", "answer_overlaps")).alias("h"))
    return hits.select("doc_id", F.col("h.items").alias("item_id"), F.col("h.scores").alias("score"), F.col("h.question_overlaps").alias("question_overlap"), F.col("h.answer_overlaps").alias("answer_overlap"))


def _as_log(rows: DataFrame) -> DataFrame:
    """A log whose messages end up as rows (conv_id, turn, role, text, _file, _row): by a hash of the row, a message comes whole, in
    two deltas, is edited from its other half to what it is, or is streamed, regenerated and streamed again. A row without a
    turn comes whole, as its events would have no order."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    front, back = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    ways = [
        F.array(event(0, "message", text)),
        F.array(event(0, "message", front), event(1, "delta", back)),
        F.array(event(0, "message", back), event(1, "edit", text)),
        F.array(event(0, "message", back), event(1, "delta", front), event(2, "regenerate", front), event(3, "delta", back)),
    ]
    way = F.when(F.col("turn").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4)))
    events = F.coalesce(*[F.when(way == k, e) for k, e in enumerate(ways)])
    message = F.concat_ws("/", F.col("_file").cast("string"), F.col("_row").cast("string"))
    out = rows.select("conv_id", "turn", "role", message.alias("message"), F.explode(events).alias("e"))
    return out.select("conv_id", (F.col("turn").cast("long") * 4 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "message", "role", F.col("e.text").alias("text"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said, 0, 0), (-1, 1, "assistant", said, 0, 1)], "conv_id long, turn long, role string, text string, _file long, _row long")
    rows = shared.numbered(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "_file", "_row").unionByName(more)
    return chat_format.digests(chat_format.render(chat_format.fold(_as_log(rows))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), labels.crc_mod("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, top=2000)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONTROL = r"(\[)(ROLE\]|INST\]|/INST\])|(<)(s>|/s>)"
_OP7 = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '{_CONTROL}', '\1\3.\2\4', 'g')) AS body,
  length(regexp_replace(replace(role, '\', '\\'), '{_CONTROL}', '\1\3.\2\4', 'g')) AS head FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN body + 4 ELSE body + head + 19 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

_RULES = ", ".join(f"({k}, {_sql(name)}, {_sql(kind)}, {_sql('>' + '>'.join(need) + '>')})" for k, (name, kind, need) in enumerate(license_scan.RULES, 1))
_STEPPED = "lower(text)"
for _pattern, _to in license_scan.STEPS:
    _STEPPED = f"regexp_replace({_STEPPED}, {_sql(_pattern)}, {_sql(_to)}, 'g')"
_OP9 = rf"""
WITH known(sentence, ident) AS (VALUES {", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in license_scan.SENTENCES.items())}),
rules(rule, license, license_class, need) AS (VALUES {_RULES}),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
sentences AS (SELECT n, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM (SELECT n, string_split({_STEPPED}, '|') AS p FROM docs)),
split AS (SELECT n, pos, list_transform(string_split(sentence, '~'), lambda x: trim(x)) AS l FROM sentences),
parts AS (SELECT n, pos, generate_subscripts(l, 1) AS i, unnest(l) AS line, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], ' '))) AS tail FROM split),
read AS (SELECT n, pos, i, a.ident AS tail_ident, b.ident AS line_ident, coalesce(min(CASE WHEN a.ident IS NOT NULL THEN i END) OVER (PARTITION BY n, pos), 1000000000) AS first
  FROM parts LEFT JOIN known a ON a.sentence = tail LEFT JOIN known b ON b.sentence = line),
ids AS (SELECT n, string_agg(ident, '>' ORDER BY pos, i) AS ids, count(*) AS k FROM (SELECT n, pos, i, CASE WHEN i = first THEN tail_ident WHEN i < first THEN line_ident END AS ident FROM read) WHERE ident IS NOT NULL GROUP BY n),
hit AS (SELECT n, min(rule) AS rule FROM ids JOIN rules ON contains('>' || ids || '>', need) GROUP BY n)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(k, 0)::BIGINT AS n_license_sentences, coalesce(hit.rule, 0)::BIGINT AS rule,
  coalesce(license, CASE WHEN k > 0 THEN 'unknown' ELSE 'none' END) AS license, coalesce(license_class, CASE WHEN k > 0 THEN 'unknown' ELSE 'none' END) AS license_class
FROM docs LEFT JOIN ids ON ids.n = docs.n LEFT JOIN hit ON hit.n = docs.n LEFT JOIN rules ON rules.rule = hit.rule"""

_OP10 = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT n, doc_id, source, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM docs),
words AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
windows AS (SELECT n, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS d, lead(word, 4) OVER p AS e FROM words WINDOW p AS (PARTITION BY n ORDER BY i)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c, d, e) AS k FROM windows WHERE e IS NOT NULL) WHERE k > 1),
covered AS (SELECT n, count(DISTINCT j) AS n_repeat FROM (SELECT n, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY n),
lines AS (SELECT n, unnest(l) AS line, generate_subscripts(l, 1) AS at FROM (SELECT n, string_split(text, chr(10)) AS l FROM docs)),
full_lines AS (SELECT *, array_to_string(list_transform(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS norm,
  len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS size FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
dups AS (SELECT n, sum(k - 1) AS n_dup FROM (SELECT n, line, count(*) AS k FROM full_lines GROUP BY 1, 2) GROUP BY n),
frequent AS (SELECT source, norm FROM full_lines JOIN docs USING (n) GROUP BY source, norm HAVING count(DISTINCT doc_id) > 200),
removed AS (SELECT n, sum(size) AS removed FROM full_lines JOIN docs USING (n) JOIN frequent f ON f.norm = full_lines.norm AND f.source IS NOT DISTINCT FROM docs.source GROUP BY n),
out AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM split LEFT JOIN covered USING (n) LEFT JOIN dups USING (n) LEFT JOIN removed USING (n))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.3::DOUBLE * n_words AS kept FROM out"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP11 = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
found AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT doc) AS docs FROM found GROUP BY 1, 2, 3),
terms AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY 1, 2 HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM terms GROUP BY 1),
pairs_of AS (SELECT DISTINCT lang, source FROM docs),
grid AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0::HUGEINT) AS n, t.n AS n_lang FROM pairs_of g JOIN terms t ON t.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
shares AS (SELECT grid.lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY grid.lang, source) + 5 * v)::HUGEINT)::BIGINT AS p, (1 + 1000000000::HUGEINT * (n_lang + 5) // (total + 5 * v))::BIGINT AS q FROM grid JOIN langs ON langs.lang = grid.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM pairs_of a JOIN pairs_of b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 50"""

_OP12 = rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents),
pieces AS (SELECT lang, unnest(p) AS piece FROM (SELECT lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM split GROUP BY 1),
grams AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cands AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
inner_runs AS (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, f, w, k, unnest(range(1, size - k + 2)) AS i FROM cands, (SELECT unnest(range(2, 5)) AS k) WHERE k < size)),
covers AS (SELECT lang, phrase, max(f) AS f FROM inner_runs GROUP BY 1, 2),
stay AS (SELECT c.* FROM cands c LEFT JOIN covers v ON v.lang = c.lang AND v.phrase = c.phrase WHERE v.f IS NULL OR v.f < c.f),
cuts AS (SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM stay)),
scored AS (SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, 1000 * c.f * t.n // (x.f * y.f) AS score FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.x JOIN counts y ON y.lang = c.lang AND y.phrase = c.y JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

#: The others need tokens, SimHash groups, trained models or BM25 passages, which SQL does not have; tests hold them
#: against plain Python, exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op7_chat_formatting": _OP7, "op9_license_scan": _OP9, "op10_quality_rules": _OP10, "op11_source_divergence": _OP11, "op12_phrase_collocations": _OP12}
