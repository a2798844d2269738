"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import (
    contamination,
    conversations,
    exactdedup,
    hyperminhash,
    jaccard,
    licences,
    packing,
    quality,
    runs,
    tokenfile,
    tokens,
    urlmodel,
    warczip,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query(
    """
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
    ), g AS (
      SELECT norm, count(*) AS group_size,
             first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM d GROUP BY norm
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM d JOIN g USING (norm)
    """
)
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf, "documents"))


LICENCE_SQL = """
    WITH known(wording, id) AS (VALUES {wordings}),
    s AS (
      SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) AS pos FROM (
        SELECT doc_id, line, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS pos FROM (
          SELECT doc_id, line, regexp_split_to_array(regexp_replace(t, '([.!?;:])\\s+', '\\1\n', 'g'), '\n') AS parts FROM (
            SELECT doc_id, unnest(lines) AS t, unnest(range(1, len(lines) + 1)) AS line FROM (
              SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+') AS lines FROM documents))))
      WHERE trim(part) <> ''
    ), f AS (
      SELECT doc_id, pos, id, row_number() OVER w AS k, lead(id, 1) OVER w AS id1, lead(pos, 1) OVER w AS pos1,
             lead(id, 2) OVER w AS id2, lead(pos, 2) OVER w AS pos2
      FROM s JOIN known ON wording = regexp_replace(regexp_replace(trim(regexp_replace(lower(part), '\\s+', ' ', 'g')),
                                     '^[\\s#*/>;-]+', ''), '[\\s.!?;:*/]+$', '')
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ), rules(name, a, b, c) AS (VALUES {rules}),
    m AS (
      SELECT doc_id, name FROM f JOIN rules ON id = a
        AND (b IS NULL OR (id1 = b AND pos1 - pos <= 1)) AND (c IS NULL OR (id2 = c AND pos2 - pos1 <= 1))
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_sentences, coalesce(l.names, '') AS licences, coalesce(l.n, 0) AS n_matches
    FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) n ON d.doc_id = n.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM m GROUP BY 1) l
      ON d.doc_id = l.doc_id
"""


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def licence_sql() -> str:
    wordings = ", ".join(f"({_quoted(w)}, {_quoted(n)})" for n, ws in licences.SENTENCES.items() for w in ws)
    steps = ", ".join(
        "(" + ", ".join(_quoted(x) for x in (name, *rule, *[None] * (3 - len(rule)))) + ")"
        for name, rule in licences.RULES
    )
    return LICENCE_SQL.format(wordings=wordings, rules=steps)


@query(licence_sql())
def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licences.recognise(table(spark, sf, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("licences", ",").alias("licences"), "n_matches")


@query(
    """
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    ), i AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
    ), iw AS (
      SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS win FROM (
        SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS p
        FROM i WHERE len(words) > 0)
    ), dw AS (
      SELECT doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') AS win FROM (
        SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p
        FROM w, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)
    ), m AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
    h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
            SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
            SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM m) GROUP BY 1)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
    """
)
def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contamination.is_contaminated(F.col("found.n_words"), F.col("found.n_hit")).alias("contaminated"),
    )


@query()
def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.classify(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlmodel.judge(table(spark, sf, "pages"))


@query()
def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query()
def op6_warc_zip(spark: SparkSession, sf: str) -> DataFrame:
    folder = warczip.archive_pages(table(spark, sf, "pages"))
    number = lambda c: F.when(F.col(c) != "None", F.col(c).cast("long"))
    return warczip.read(spark, folder, with_payload=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


@query()
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    damaged = F.coalesce(F.when(seed % 10 == 0, runs.looped(F.col("text"), F.floor(seed / 10))), F.col("text"))
    found = runs.periodic_runs(docs.select("doc_id", damaged.alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    by_length = lambda r: F.struct(-r["length"], r["start"], r["period"])
    longest = F.array_min(F.transform("found.runs", by_length))
    lines = F.transform("found.runs", lambda r: F.concat(line(r), F.lit("\n")))
    length, period = -longest["col1"], longest["period"]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("found.runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"),
    )


@query()
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.audited(table(spark, sf, "conversations"))


@query()
def op11_hyperminhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))
