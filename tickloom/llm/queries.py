"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

from . import bitplanes, bm25_packing, collocations, grace_dedup, html_model, licenses, mixing, order_minhash, ppm
from . import projected_neighbours, risk_rules, spelling, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bm25_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = bm25_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids")


def op2_bitplanes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "planes")
    bitplanes.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return bitplanes.read_ids(spark, path, ids=False)


def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents")).drop("text_key")


def op4_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = risk_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), joint=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"counts.{name}" for name in names], "base_failed", "kept")


def op5_block_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(table(spark, folder, "documents")).taken
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_html_model(spark: SparkSession, folder: str) -> DataFrame:
    return html_model.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op7_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return grace_dedup.exact_groups(table(spark, folder, "documents"))


def op8_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    found = warc.captures(warc.read_records(spark, path))

    def number(name: str):
        return F.try_element_at("metadata.fields", F.lit(name)).try_cast("long")

    return found.select(
        number("page-id").alias("page_id"),
        number("payload-length").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("refers-to-page").alias("refers_to"),
    )


def op9_ppm(spark: SparkSession, folder: str) -> DataFrame:
    scored = ppm.score_documents(table(spark, folder, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_all(table(spark, folder, "documents"))
    return found.select("doc_id", "unit", "line", "last_line", "template", "license", F.round("dice", 9).alias("dice"))


def op11_pivotal_spelling(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.runs(table(spark, folder, "documents"))
    return spelling.variants(spelling.counted(spelling.with_slips(runs)))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return projected_neighbours.neighbours(vectors.where("vec_id % 50 = 0"), vectors)


def queries() -> dict[str, Query]:
    return {
        "op1_bm25_packing": op1_bm25_packing,
        "op2_bitplanes": op2_bitplanes,
        "op3_order_minhash": op3_order_minhash,
        "op4_risk_rules": op4_risk_rules,
        "op5_block_mixing": op5_block_mixing,
        "op6_html_model": op6_html_model,
        "op7_grace_dedup": op7_grace_dedup,
        "op8_warc_captures": op8_warc_captures,
        "op9_ppm": op9_ppm,
        "op10_license_scan": op10_license_scan,
        "op11_pivotal_spelling": op11_pivotal_spelling,
        "op12_collocations": op12_collocations,
        "op13_projected_neighbours": op13_projected_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_grace_dedup": """
            WITH d AS (
              SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
            ), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
            FROM d JOIN g USING (t)
        """,
        "op8_warc_captures": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            g AS (SELECT html, max(page_id) AS first_id FROM p GROUP BY html),
            h AS (
              SELECT page_id, first_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS hex
              FROM p JOIN g ON p.html = g.html
            ), b AS (
              SELECT *, list_transform(range(32), lambda i: (
                16 * ((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1))
                + CASE WHEN 5 * i // 4 + 2 <= 40
                    THEN instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INT), 1)) - 1 ELSE 0 END
              ) >> CAST(3 - (5 * i) % 4 AS INT) & 31) AS fives FROM h
            )
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
              list_aggregate(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
              CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
              CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM b
        """,
        "op11_pivotal_spelling": """
            WITH RECURSIVE runs AS (
              SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
            ), once AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
            fours AS (
              SELECT list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, z:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
            ), hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM once),
            halves AS (
              SELECT doc_id, run, c, list_transform(range(length(x)), lambda k: CAST(
                instr('0123456789ABCDEF', substr(x, CAST(k - k % 2 + 2 - k % 2 AS INT), 1)) - 1 AS BIGINT)) AS b FROM hexed
            ), checked AS (
              SELECT doc_id, run, c, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda h, v:
                xor(step[CAST((xor(h, v) & 15) + 1 AS INT)], h >> 4))) AS h FROM halves, fours
            ), slipped AS (
              SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) + 2 AS INT))
                ELSE run END AS word FROM checked
            ), words AS (
              SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
            ), without AS (
              SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i + 2 AS INT)) AS rest
              FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
            ), pairs AS (
              SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
              UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
            ), ranked AS (
              SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r
              FROM pairs
            ), judged AS (
              SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
                CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
              FROM words w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1
            ), chain AS (
              SELECT word, word AS root, 0 AS steps FROM judged
              UNION ALL SELECT chain.word, j.form, steps + 1 FROM chain JOIN judged j ON j.word = chain.root WHERE j.form IS NOT NULL
            ), ends AS (SELECT word, max_by(root, steps) AS root FROM chain GROUP BY word)
            SELECT j.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged j JOIN ends e ON e.word = j.word
        """,
        "op12_collocations": """
            WITH pieces AS (
              SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
            ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
            grams AS (
              SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
              FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS size))
            ), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
            totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
            c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
            cuts AS (
              SELECT lang, size, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : size], ' ') AS y
              FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
            ), scored AS (
              SELECT t.lang, t.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score
              FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = t.x JOIN f y ON y.lang = t.lang AND y.phrase = t.y
              QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, k) = 1
            ), inside AS (
              SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
              FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c)) GROUP BY 1, 2
            ), ranked AS (
              SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
              FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
              WHERE longer IS NULL OR 100 * longer < 80 * a
            )
            SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
            FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
        """,
    }
