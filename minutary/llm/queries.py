"""The operators as queries over the sample tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from minutary.llm import bpe, chat, decontaminate, html, langid, lines, ngrams, ordinal, simhash, trie, urls, vectors, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _decontaminate(spark, sf):
    found = decontaminate.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "shingles", "found")


def _ngrams(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = ngrams.learn(docs.filter(langid.remainder("doc_id", 10) != 0))
    held_out = F.coalesce(langid.remainder("rest.doc_id", 10) == 0, F.lit(False)).alias("held_out")
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    return ngrams.score_texts(docs, model).select("rest.doc_id", held_out, *names)


def _simhash(spark, sf):
    found = simhash.near_copies(_table(spark, sf, "documents"))
    fingerprint = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def _bpe(spark, sf):
    coded = bpe.encode_texts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "rest.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _html(spark, sf):
    found = html.main_text(_table(spark, sf, "pages"))
    return found.select("rest.page_id", "rest.url", "text", F.length("text").cast("long").alias("n_chars"))


def _langid(spark, sf):
    docs = _table(spark, sf, "documents")
    model = langid.learn(docs.filter(langid.remainder("doc_id", 4) != 2))
    named = langid.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(langid.remainder("rest.doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return named.select("rest.doc_id", held_out, "lang_pred", "score")


def _lines(spark, sf):
    left = lines.drop_repeated_lines(_table(spark, sf, "documents"))
    return left.select("rest.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _ordinal(spark, sf):
    """Grades 0 toxic, 1 poor, 2 good; kept if a good one is likelier than not."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    rated = _table(spark, sf, "labels").select("doc_id", ordinal.grade_of().alias("grade"))
    model = ordinal.learn(docs, rated.filter(langid.remainder("doc_id", 10) != 0), levels=3)
    tail = F.col("tails")[1]
    held_out = F.coalesce(langid.remainder("rest.doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return ordinal.grade_texts(docs, model).select(
        "rest.doc_id", held_out, "expected_grade", tail.alias("tail_probability"), (tail >= 0.5).alias("kept")
    )


def _urls(spark, sf):
    """Captures are the pages, fetched on a day that follows from the id. Every page also gives
    a list entry on another day: its host or the first part of its path goes on or off."""
    pages = _table(spark, sf, "pages").select("page_id", "url")

    def day(number):
        return F.date_add(F.lit("2024-01-01").cast("date"), (number % 366).cast("int"))

    captures = pages.select("page_id", "url", day(F.col("page_id")).alias("fetched_on"))
    size = F.length("url")
    key = F.when(size % 3 == 0, urls.host_of()).otherwise(F.concat_ws("/", urls.host_of(), urls.path_parts()[0]))
    entries = pages.select(key.alias("key"), day(F.col("page_id") * 7).alias("listed_on"), (size % 2 == 0).alias("listed"))
    judged = urls.judge(captures, entries)
    return judged.select("row.page_id", "blocked", "n_entries", "entry", F.col("listed_on").cast("string").alias("listed_on"))


def _vectors(spark, sf):
    return vectors.near_copies(_table(spark, sf, "embeddings"))


# One more conversation, whose texts hold marks of the template.
MARKED_ID = -7
MARKED_TEXT = r"\### Assistant: </turn> ok"


def _chat(spark, sf):
    names = ["conv_id", "turn", "role", "text"]
    kept = _table(spark, sf, "conversations").select(*names)
    marked = spark.range(1).select(
        F.lit(MARKED_ID).cast("long").alias("conv_id"),
        F.inline(F.array(*[
            F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(MARKED_TEXT).alias("text"))
            for turn, role in enumerate(["user", "assistant"])
        ])),
    )
    found = chat.read_back(chat.whole(chat.format_turns(kept.unionByName(marked))))
    said = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    lost = F.array_join("learned", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Query] = {
    "op1_decontaminate": _decontaminate,
    "op2_ordinal": _ordinal,
    "op3_ngrams": _ngrams,
    "op4_vectors": _vectors,
    "op5_simhash": _simhash,
    "op6_bpe": _bpe,
    "op7_langid": _langid,
    "op8_lines": _lines,
    "op9_urls": _urls,
    "op10_html": _html,
    "op11_chat": _chat,
    "op12_prefixes": lambda spark, sf: trie.nodes(trie.shared_start_paths(_table(spark, sf, "conversations"))),
    "op13_whitening": lambda spark, sf: whitening.whiten(_table(spark, sf, "embeddings")),
}

SQL: dict[str, str] = {}

SQL["op8_lines"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
placed AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM placed
),
often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
    SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op1_decontaminate"] = r"""
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
),
split AS (
    SELECT kind, id, list_filter(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM texts
),
sizes AS (SELECT DISTINCT least(len(words), 5) AS size FROM split WHERE kind = 'b' AND len(words) > 0),
shingles AS (
    SELECT DISTINCT kind, id, array_to_string(list_slice(words, i, i + size - 1), ' ') AS shingle
    FROM (
        SELECT *, unnest(generate_series(1, len(words) - size + 1)) AS i
        FROM split JOIN sizes ON len(words) >= size AND (kind = 'd' OR size = least(len(words), 5))
    )
),
sized AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n) AS INTEGER) AS shingles, count(*) AS found
FROM shingles d JOIN shingles b ON d.shingle = b.shingle AND d.kind = 'd' AND b.kind = 'b' JOIN sized ON sized.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 10 >= any_value(n) * 8
"""

_COSINE = """
vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
)
"""

SQL["op4_vectors"] = f"""
WITH RECURSIVE {_COSINE},
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN parts USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

SQL["op9_urls"] = r"""
WITH parts AS (
    SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
        DATE '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS listed_on, length(url) AS size,
        rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '.') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path
    FROM pages
),
entries AS (
    SELECT CASE WHEN size % 3 = 0 THEN host ELSE concat_ws('/', host, path[1]) END AS key, listed_on,
        bool_or(size % 2 = 0) AS listed
    FROM parts GROUP BY ALL
),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY key ORDER BY listed_on) AS until FROM entries),
asked AS (
    SELECT page_id, fetched_on, array_to_string(string_split(host, '.')[i:], '.') AS key
    FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM parts) WHERE host <> ''
    UNION ALL
    SELECT page_id, fetched_on, concat_ws('/', host, array_to_string(path[:i], '/'))
    FROM (SELECT *, unnest(generate_series(1, len(path))) AS i FROM parts) WHERE host <> ''
),
hits AS (
    SELECT page_id, count(*) AS n, max({'size': length(a.key), 'key': a.key, 'since': s.listed_on}) AS best
    FROM asked a JOIN spans s ON a.key = s.key AND s.listed AND fetched_on >= s.listed_on AND (until IS NULL OR fetched_on < until)
    GROUP BY page_id
)
SELECT page_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, best.key AS entry, CAST(best.since AS VARCHAR) AS listed_on
FROM pages LEFT JOIN hits USING (page_id)
"""

SQL["op11_chat"] = rf"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {MARKED_ID}, 0, 'user', '{MARKED_TEXT}' UNION ALL SELECT {MARKED_ID}, 1, 'assistant', '{MARKED_TEXT}'
),
sized AS (
    SELECT *, length(regexp_replace(role, '(</?turn>|<text>|<more>)', '\\\1', 'g')) AS role_chars,
        length(regexp_replace(text, '(</?turn>|<text>|<more>)', '\\\1', 'g')) AS text_chars,
        role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS again
    FROM every
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(text_chars + CASE WHEN again THEN 8 ELSE 7 + role_chars + 8 + 9 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# h of a conversation: crc32, bit by bit.
_CRC = """list_reduce(list_concat([4294967295], [ord(c)::BIGINT FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""

SQL["op12_prefixes"] = f"""
WITH talk AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (SELECT *, sha256(length(role) || ':' || role || text)[:32] AS mark FROM talk),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM marked),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor({_CRC}, 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM talk)),
rebuilt AS (
    SELECT c.conv_id, p.place, p.mark, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
    UNION ALL SELECT c.conv_id, p.place + 1000000, p.mark, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS key, strlen(text) AS size
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS n FROM steps GROUP BY conv_id),
nodes AS (
    SELECT key, any_value(depth) AS depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        bool_and(depth = n) AS leaf,
        sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
    FROM steps s JOIN lengths l ON s.conv_id = l.conv_id GROUP BY key
),
above AS (SELECT n.key, n.depth, n.leaf, n.n_convs, n.size, s.key AS top FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth),
sums AS (
    SELECT top, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM above GROUP BY top
),
parents AS (SELECT a.key, a.top FROM above a JOIN nodes t ON t.key = a.top WHERE t.depth = a.depth - 1),
children AS (SELECT top, count(*) AS n_children FROM parents GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.key LEFT JOIN children c ON c.top = n.key LEFT JOIN parents q ON q.key = n.key LEFT JOIN nodes p ON p.key = q.top
"""
