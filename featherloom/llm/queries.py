"""Queries of the subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm.words import LOWER, UPPER

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from featherloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    told, name = quality.judge(docs.select("doc_id", "text"), rules)
    v = F.col(name)
    return told.select(
        "doc_id",
        *(v["s"][c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        v["base_failed"].alias("base_failed"),
        v["rule"].alias("rule"),
        v["kept"].alias("kept"),
    )


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    from featherloom.llm import packing, tokens

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary())


@query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the token store's files give them back."""
    from featherloom.llm import token_store, tokens
    from featherloom.session import scratch_path

    path = scratch_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, tokens.vocabulary())
    return token_store.checked(spark, path)


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of each document."""
    from featherloom.llm import minhash

    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_int8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each embedding."""
    from featherloom.llm import vector_dedup

    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op9_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    from featherloom.llm import language_id

    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many recur elsewhere, and a digest of the text without those."""
    from featherloom.llm import line_dedup

    clean, counts = line_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col(counts)
    return clean.select(
        "doc_id", c["n_lines"].alias("n_lines"), c["n_dropped"].alias("n_dropped"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
    )


SQL["op1_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), words AS (
  SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw
), tokens AS (
  SELECT doc_id, pos, w, len(w) AS n,
         [CASE WHEN regexp_matches(x, '[0-9]|@|://') THEN '<*>' ELSE x END FOR x IN w] AS t
  FROM words WHERE len(w) >= 5
), judged AS (
  SELECT *, 3 * len([x FOR x IN t IF x = '<*>']) > n AS own FROM tokens
), masked AS (
  SELECT doc_id, pos, n, t FROM judged WHERE NOT own
), parts AS (
  SELECT doc_id, pos, n, t, j, 2 + ((n - 2) * j) // 4 AS b, 2 + ((n - 2) * (j + 1)) // 4 AS e
  FROM masked, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE n >= 8
), keys AS (
  SELECT doc_id, pos, concat(n, ' ', j, ' ', array_to_string(list_concat(t[1:b], ['<*>'], t[e + 1:n]), ' ')) AS k FROM parts
  UNION ALL
  SELECT doc_id, pos, concat(n, ' - ', array_to_string(t, ' ')) FROM masked WHERE n < 8
  UNION ALL
  SELECT doc_id, pos, concat(n, ' = ', array_to_string(w, ' ')) FROM judged WHERE own
), firsts AS (
  SELECT k, min(struct_pack(d := doc_id, p := pos)) AS f FROM keys
  GROUP BY k HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, pos FROM keys JOIN firsts USING (k) WHERE struct_pack(d := doc_id, p := pos) <> f
)
SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
       md5(coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL), '')) AS text_md5
FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos
GROUP BY r.doc_id
"""


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with a domain: these tables have none, so their sources are dealt to three by their number."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*map(F.lit, ("web", "books", "forums"))), (number % 3 + 1).cast("int")))


#: Target weights: unnamed values weigh 1.
WEIGHTS = {
    "domain": {"web": 0.5, "books": 0.3, "forums": 0.2},
    "lang": {"en": 0.6, "de": 0.2, "fr": 0.1, "es": 0.1},
}


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for the target weights, once for each epoch that takes them."""
    from featherloom.llm import mixing
    from featherloom.session import seal

    docs = with_domain(table(spark, sf_dir, "documents"))
    settings = mixing.MixSettings(weights=WEIGHTS)
    counts = seal(mixing.counted(docs, settings), "token-counts")
    taken, epoch = mixing.mix(counts, settings, counts)
    return taken.select("doc_id", F.col(epoch).alias("epoch"), *settings.levels, "n_tokens")


def _mix_level(level: str, above: list[str], weights: str) -> str:
    """One level of the budget tree in SQL: table ``b_<level>`` (levels, budget)."""
    own = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    join = f"JOIN b_{above[-1]} USING ({', '.join(above)})" if above else "CROSS JOIN b_root"
    return f"""
n_{level} AS (
  SELECT {own}, CAST(sum(supply) * 2 AS DOUBLE) AS cap, CAST({weights} AS DOUBLE) AS w FROM leaves GROUP BY {own}
), o_{level} AS (
  SELECT *, budget - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(w) OVER ({part}) - coalesce(sum(w) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft
  FROM n_{level} {join} WINDOW p AS ({part} ORDER BY cap / w, {level})
), f_{level} AS (
  SELECT *, cap * wleft <= room * w AS filled FROM o_{level}
), b_{level} AS (
  SELECT {own}, CASE WHEN filled THEN cap ELSE greatest(0, least(cap,
           (budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part})) * w
           / sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}))) END AS budget
  FROM f_{level}
)"""


SQL["op2_source_mix"] = (
    r"""
WITH rows_ AS (
  SELECT doc_id,
         ['web', 'books', 'forums'][1 + coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 3] AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS supply FROM rows_ GROUP BY ALL
), b_root AS (
  SELECT CAST(least(sum(supply) * 2, floor(sum(supply) * 0.75)) AS DOUBLE) AS budget FROM leaves
), """
    + ", ".join(
        [
            _mix_level("domain", [], "CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.3 WHEN 'forums' THEN 0.2 ELSE 1 END"),
            _mix_level("lang", ["domain"], "CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.1 WHEN 'es' THEN 0.1 ELSE 1 END"),
            _mix_level("source", ["domain", "lang"], "1"),
        ]
    )
    + """, plan AS (
  SELECT domain, lang, source, supply, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM leaves JOIN b_source USING (domain, lang, source)
), open_ AS (
  SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole FROM plan
), drawn AS (
  SELECT r.*, whole, budget - whole * supply AS rest, supply, md5(concat('17:', whole, ':', doc_id)) AS draw
  FROM rows_ r JOIN open_ USING (domain, lang, source)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw) AS s FROM drawn
), times AS (
  SELECT *, whole + CASE WHEN (rest > 0 OR supply = 0) AND s <= rest THEN 1 ELSE 0 END AS n FROM summed
)
SELECT doc_id, CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM times
"""
)


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as responses, read, derived, written as derivatives and read again: one row per derived record."""
    from featherloom.llm import warc
    from featherloom.session import scratch_path

    responses, derived = scratch_path(spark, "warc-responses"), scratch_path(spark, "warc-derived")
    warc.write(warc.page_responses(table(spark, sf_dir, "pages")), responses)
    warc.write(warc.derive(warc.read(spark, responses)), derived)
    own = F.map_from_arrays("headers.name", "headers.value")
    return warc.read(spark, derived).select(
        own["X-Page-Id"].cast("bigint").alias("page_id"),
        "type",
        "record_id",
        "refers_to",
        "uri",
        "date",
        "content_type",
        own["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
        own["WARC-Block-Digest"].alias("block_digest"),
        F.octet_length("block").cast("bigint").alias("block_bytes"),
    )


@query
def op4_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under the network and under smoothed word frequencies."""
    from featherloom.llm import language_id, lm

    docs = table(spark, sf_dir, "documents")
    return lm.score_documents(docs, language_id.held_out("doc_id", 1))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from featherloom.llm import token_counts, tokens

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokens.vocabulary())


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and what it folds to after tampering with a third of them."""
    from featherloom.llm import merkle

    return merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), merkle.tampered()))


def _merkle_level(name: str, below: str) -> str:
    """Parents of one level in SQL, and the siblings of the nodes below; a lone node stays itself."""
    return f"""
{name} AS MATERIALIZED (
  SELECT tree, i // 8 AS i, (any_value(n) + 7) // 8 AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {below} GROUP BY tree, i // 8
), {name}_s AS MATERIALIZED (
  SELECT a.tree, a.i, any_value(a.n) AS n,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {below} a JOIN {below} b ON a.tree = b.tree AND a.i // 8 = b.i // 8 GROUP BY a.tree, a.i
)"""


def _merkle_sql(tree_levels: int = 8, top_levels: int = 3) -> str:
    """Trees of up to 8**tree_levels rows, up to 8**top_levels trees."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    told = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)
    crc = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
      FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    levels = [_merkle_level(f"a{k + 1}", f"a{k}") for k in range(tree_levels)]
    tops = [_merkle_level(f"b{k + 1}", f"b{k}") for k in range(top_levels)]
    steps, fold, proof = "", "d.claim", []
    for prefix, count, key in (("a", tree_levels, "d.tree"), ("b", top_levels, "''")):
        for k in range(1, count + 1):
            place = "d.i" if prefix == "a" else "t.i"
            s = f"{prefix}{k}_s"
            steps += f"\n  JOIN {s} ON {s}.tree = {key} AND {s}.i = {place} // {8 ** (k - 1)}"
            proof.append(f"CASE WHEN {s}.n > 1 THEN {s}.l || {s}.r ELSE '' END")
    # One fold a level: a column of a table of its own, so that no expression repeats itself.
    cells = ", ".join(
        f"{p}{k}_s.n AS {p}n{k}, {p}{k}_s.l AS {p}l{k}, {p}{k}_s.r AS {p}r{k}" for p, c in (("a", tree_levels), ("b", top_levels)) for k in range(1, c + 1)
    )
    folds, last = "", "f0"
    for p, c in (("a", tree_levels), ("b", top_levels)):
        for k in range(1, c + 1):
            folds += f", f_{p}{k} AS (SELECT * REPLACE (CASE WHEN {p}n{k} > 1 THEN sha256({p}l{k} || claim || {p}r{k}) ELSE claim END AS claim) FROM {last})"
            last = f"f_{p}{k}"
    return f"""
WITH told AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, text, {told} AS fields,
         doc_id IS NOT NULL AND {crc} % 3 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(fields || coalesce(strlen(text) || ':' || CASE WHEN hit THEN {low} ELSE text END, '-')) AS claim
  FROM told
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), a0 AS (SELECT tree, i, n, h FROM placed), {", ".join(levels)},
tops AS MATERIALIZED (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM a{tree_levels}),
b0 AS (SELECT '' AS tree, i, n, h FROM tops), {", ".join(tops)},
f0 AS (
  SELECT d.doc_id, d.h AS leaf, t.h AS subroot, (SELECT h FROM b{top_levels}) AS root, d.claim,
         sha256({" || ".join(proof)}) AS proof_sha256, {cells}
  FROM placed d JOIN tops t ON t.name = d.tree{steps}
){folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, claim AS folded_root, claim = root AS verified FROM {last}"""


SQL["op13_merkle_manifest"] = _merkle_sql()


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for each benchmark item."""
    from featherloom.llm import lexical

    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL["op12_lexical_search"] = f"""
WITH docs AS MATERIALIZED (
  SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs
), items AS MATERIALIZED (
  SELECT k, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS t FROM benchmark)
), cells AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM cells, totals GROUP BY term
), scored AS (
  SELECT k, any_value(item_id) AS item_id, c.r, any_value(d.doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.t) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items i JOIN cells c USING (term) JOIN weights USING (term) JOIN docs d ON d.r = c.r, totals GROUP BY k, c.r
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""
