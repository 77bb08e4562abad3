"""Queries of the operators over the supplied tables, and SQL giving the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm import exact, extract, interaction, language, licences, minhash, packing, quality, repair, spots, unigram, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def small_batches(spark: SparkSession) -> None:
    """Long texts: 1,000 rows at a time go to Python, so that two tasks of an executor hold some megabytes each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_exact_dedup",
    """
    WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
    FROM t WINDOW w AS (PARTITION BY h)
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact.label_copies(table(spark, folder, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_minhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_groups(table(spark, folder, "documents"), width=2)


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
    d AS (SELECT *, [('0x' || substr(hex, 1 + 10 * k, 10))::BIGINT FOR k IN range(4)] AS parts FROM h)
    SELECT page_id, payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + c // 8] >> (35 - 5 * (c % 8))) & 31)::INT, 1) FOR c IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


@query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


_ANCHOR = f"(x IN ({', '.join(f"'{w}'" for w in spots.ANCHORS)}) OR length(x) = {spots.ANCHOR_LENGTH})"


def _signatures(text: str) -> str:
    """SQL for the sorted distinct signatures of a text."""
    return f"""(SELECT list_sort(list_distinct(CASE WHEN len(spots) > 0 THEN spots ELSE list_transform(w, lambda x: substr(md5(x), 1, 8)) END))
      FROM (SELECT w, list_filter(list_transform(marks, lambda m, j: substr(md5(m.w || ' ' || content[m.i - j + 1] || ' ' || content[m.i - j + 2]), 1, 8)), lambda x: x IS NOT NULL) AS spots
        FROM (SELECT w, list_filter(w, lambda x: NOT {_ANCHOR}) AS content,
                list_filter(list_transform(w, lambda x, i: {{'w': x, 'i': i}}), lambda m: {_ANCHOR.replace('(x', '(m.w').replace('length(x', 'length(m.w')}) AS marks
          FROM (SELECT list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w))))"""


def _likeness(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END"


@query(
    "op10_spot_signatures",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM n),
    s AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_signatures("text")} AS a, {_signatures("edited")} AS b, {_signatures("next_text")} AS c FROM e)
    SELECT doc_id, n_chars, edited_sha256, array_to_string(a, ' ') AS fingerprint, array_to_string(b, ' ') AS edited_fingerprint,
           {_likeness("a", "b")} AS near_edited, {_likeness("a", "c")} AS near_next
    FROM s
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = spots.fingerprint_edits(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, to in licences.STEPS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern, to.replace("$", "\\"))
    return f"trim({out})"


def _known() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.TEXTS)
    return f"known AS (SELECT sha256({_canonical('text')}) AS digest, min(licence) AS licence FROM (VALUES {values}) AS t(licence, text) GROUP BY 1)"


@query(
    "op4_license_scan",
    f"""
    WITH {_known()},
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, sha256({_canonical("text")}) AS text_digest FROM d),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM l JOIN known ON digest = sha256({_canonical("line")}) GROUP BY doc_id)
    SELECT w.doc_id, text_digest, licence AS license_id, coalesce(notices, '') AS notices
    FROM w LEFT JOIN known ON digest = text_digest LEFT JOIN n ON n.doc_id = w.doc_id
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", F.col("licence").alias("license_id"), F.array_join("notices", ",").alias("notices"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    model = unigram.load(tokenizer_path("piece_bpe_32k.model"))
    rows = unigram.round_trip(table(spark, folder, "documents").select("doc_id", "text"), model)
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


@query(
    "op11_filter_interaction",
    f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    m AS (SELECT part, doc_id,
            (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
            + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m
          FROM w),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m),
    f AS (SELECT unnest(string_split('ABCDE', '')) AS f),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT o AS filter_order, k::INT AS step, substr(o, k, 1) AS f,
            list_sum([1 << (ascii(x) - 65) FOR x IN string_split(substr(o, 1, k), '')])::INT AS upto,
            (1 << (ascii(substr(o, k, 1)) - 65))::INT AS bit FROM o, range(1, 6) AS r(k)),
    t AS (SELECT part, filter_order, step, f,
            sum(n) FILTER (m & upto = 0) AS kept, sum(n) FILTER (m & upto = bit) AS removed,
            sum(n) FILTER (m & bit > 0 AND m & upto <> bit) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
            sum(good) FILTER (m & upto = bit) AS good_lost, sum(toxic) FILTER (m & upto = bit) AS toxic_lost
          FROM c, s GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in interaction.COUNTS)},
           coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
    FROM t
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    masks = interaction.five_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return interaction.audit(masks)


_SPACES = r"\x20\x09-\x0D"
_IMPOSSIBLE = 1 << 40


def _edit(state: str, cost: str, letters: str, lines: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 't': list_concat({state}.t, {lines})}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _on(state: str, initial: str, role: str) -> list[str]:
    """Keep and change of role from a state to a user or assistant turn."""
    return [
        _edit(state, f"CASE WHEN NOT doomed AND r = '{initial}' THEN cut ELSE {_IMPOSSIBLE} END", "K", "[role || ':' || text]"),
        _edit(state, f"CASE WHEN doomed THEN {_IMPOSSIBLE} ELSE 3 + cut END", "R", f"['{role}:' || text]"),
    ]


_CRC = """xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295)"""


@query(
    "op12_conversation_repair",
    f"""
    WITH RECURSIVE c AS (
      SELECT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    h AS (SELECT *, {_CRC} % 20 AS f FROM c),
    d AS (SELECT key, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE f <> 0),
    o AS (SELECT *, substr(role, 1, 1) AS r, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i,
            row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
    g AS (SELECT *, lag(r) OVER (PARTITION BY key ORDER BY i) AS r0,
            CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN regexp_matches(text, '[^{_SPACES}.!?][{_SPACES}]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
    rows AS (SELECT *, fault IN ('blank', 'duplicate') AS doomed, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM g),
    stat AS (SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY key),
    walk AS (
      SELECT key, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': {_IMPOSSIBLE}::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s1,
             {{'c': 3::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM stat
      UNION ALL
      SELECT key, i, n0, n1, {_least("n2", *[_edit(s, "3", "I", "['user:']") for s in ("n0", "n1", "n3")])},
             {_least("n3", _edit("n2", "3", "I", "['assistant:']"), *[_edit(s, "6", "II", "['user:', 'assistant:']") for s in ("n0", "n1")])}
      FROM (SELECT key, rows.i AS i, {_edit("s0", "4", "D", "[]::VARCHAR[]")} AS n0,
              {_least(_edit("s1", "4", "D", "[]::VARCHAR[]"), _on("s0", "s", "")[0])} AS n1,
              {_least(_edit("s2", "4", "D", "[]::VARCHAR[]"), *_on("s0", "u", "user"), *_on("s1", "u", "user"), *_on("s3", "u", "user"))} AS n2,
              {_least(_edit("s3", "4", "D", "[]::VARCHAR[]"), *_on("s2", "a", "assistant"))} AS n3
            FROM walk JOIN rows USING (key) WHERE rows.i = walk.i + 1)),
    best AS (SELECT stat.*, {_least("s0", "s3")} AS b FROM walk JOIN stat USING (key) WHERE i = n)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, key FROM c) LEFT JOIN best USING (key)
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(repair.damage(rows)).withColumnRenamed("conv_id", "id")
    every = rows.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return joined.select("conv_id", *[c.alias(n) for n, c in {**zero, **empty}.items()])


URL_RULES = [
    urls.Rule.parse("allow", "org/"),
    urls.Rule.parse("block", "example.org/es/"),
    urls.Rule.parse("block", "example.org/en/1"),
    urls.Rule.parse("allow", "com/fr/"),
    urls.Rule.parse("block", "com/de/"),
]


@query(
    "op13_url_filters",
    f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    a AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
            translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM u),
    h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    r(verdict, rule_host, rule_path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
    best AS (SELECT page_id, arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}}, [length(rule_host || rule_path), length(rule_host)]) AS b
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
    v(term, weight) AS (VALUES {", ".join(f"('{t}', {n})" for t, n in urls.VOCABULARY.items())}),
    hits AS (SELECT page_id, sum(weight)::BIGINT AS weight, string_agg(term, ' ' ORDER BY term) AS terms
      FROM h JOIN v ON contains(low, term) AND regexp_matches(low, '(^|[^a-z])' || term || '([^a-z]|$)') GROUP BY page_id)
    SELECT h.page_id, host, path, b.rule AS rule,
           coalesce(b.verdict, CASE WHEN coalesce(weight, 0) >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
           coalesce(weight, 0) AS weight, coalesce(terms, '') AS terms
    FROM h LEFT JOIN best USING (page_id) LEFT JOIN hits USING (page_id)
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "weight", "terms")
