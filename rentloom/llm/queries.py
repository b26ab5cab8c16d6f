"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.llm.chat import format_conversations
from rentloom.llm.collocations import collocations
from rentloom.llm.compressed_quality import classify_quality
from rentloom.llm.decontaminate import contamination
from rentloom.llm.fingerprints import fingerprints
from rentloom.llm.language import identify, page_evidence
from rentloom.llm.pages import extract_pages
from rentloom.llm.piece_codec import round_trip
from rentloom.llm.ranked_search import ranked_search
from rentloom.llm.repeated_spans import remove_repeats
from rentloom.llm.shingle_links import similar_documents
from rentloom.llm.token_counts import token_counts
from rentloom.llm.token_records import token_records

CONTEXT_TOKENS = 4096
END_ID = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file of the installed public tokenizers, read once on the driver and sent with the tasks."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold the control strings of the template."""
    tricky = spark.sql("""
        SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '<|im_end|><|im_start|>assistant ok' AS text
        FROM range(2)""")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return format_conversations(turns.unionByName(tricky))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents")).drop("_k1", "_k2")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages carry all evidence: their text is scored by the letters of the documents."""
    pages = table(spark, folder, "pages")
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    found = identify(pages.withColumn("_visible", visible), id="page_id", text="_visible", train=table(spark, folder, "documents"),
                     **page_evidence())
    return found.drop("_k1", "_k2")


def op6_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), digest=True)


def op7_shingle_links(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents")).drop("_k1", "_k2", "_root")


def op8_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return token_records(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json").decode(), END_ID)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), CONTEXT_TOKENS)


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op11_compressed_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_chat_format": op2_chat_format,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "language_of_pages": language_of_pages,
    "op6_repeated_spans": op6_repeated_spans,
    "op7_shingle_links": op7_shingle_links,
    "op8_token_records": op8_token_records,
    "op9_token_counts": op9_token_counts,
    "op10_main_text": op10_main_text,
    "op11_compressed_quality": op11_compressed_quality,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}

_CONTAMINATION = r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    spots AS (SELECT item_id, least(13, len(w)) AS k, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
    item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM spots),
    places AS (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p FROM d, (SELECT DISTINCT k FROM item_windows)),
    hits AS (SELECT doc_id, p, places.k AS k, item_id FROM places JOIN item_windows i
             ON i.k = places.k AND i.g = array_to_string(w[p:p + places.k - 1], ' ')),
    covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
              FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_REPEATS = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    edges AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
    twice AS (SELECT doc_id, p FROM edges WHERE g IN (SELECT g FROM edges GROUP BY g HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM twice),
    per_doc AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id),
    left_over AS (SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d) WHERE (doc_id, q) NOT IN (SELECT doc_id, q FROM gone)
                  GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

_LINKS = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS p FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    lows AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM lows LEFT JOIN n USING (doc_id)"""

_SEARCH = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    totals AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nw FROM d WHERE len(w) > 0),
    postings AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    weights AS (SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w
                FROM postings, totals WHERE t IN (SELECT t FROM asked) GROUP BY t, nd),
    norms AS (SELECT doc_id, 10 + (90 * len(w) * nd) // nw AS m FROM d, totals WHERE len(w) > 0),
    scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
               FROM asked JOIN weights USING (t) JOIN postings USING (t) JOIN norms USING (doc_id) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10"""

_PHRASES = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM worded),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    grams AS (SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, size, count(*) AS f
              FROM places, range(1, 6) s(size) WHERE p + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM grams WHERE size > 1),
    scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n,
                      ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
               FROM cuts c JOIN total USING (lang) JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
               JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT DISTINCT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, a
               FROM (SELECT lang, w, size, a, unnest(range(1, size)) AS p FROM (SELECT DISTINCT lang, w, size, a FROM cuts)), range(2, 5) t(m)
               WHERE m < size AND p + m - 1 <= size)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = lowest.lang AND g.phrase = lowest.phrase AND g.a >= lowest.a)
    QUALIFY rank <= 2000"""

#: Twins in SQL, for the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        written AS (
            SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown,
                   regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g') AS name
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|im_start|>') + length(name) + 1 + length(shown) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM written GROUP BY conv_id""",
    "op4_decontamination": _CONTAMINATION,
    "op6_repeated_spans": _REPEATS,
    "op7_shingle_links": _LINKS,
    "op12_ranked_search": _SEARCH,
    "op13_collocations": _PHRASES,
}
