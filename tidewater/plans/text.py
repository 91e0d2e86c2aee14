"""Catalogue: masking, chunks, the inverted index, retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import analyse, masking
from tidewater.functions.scalar import identifiers
from tidewater.operators import relevance
from tidewater.operators import retrieval as R
from tidewater.operators.materialise import scratch, state_of, written
from tidewater.operators.textindex import TextIndex
from tidewater.operators.vectorindex import VectorIndex, exact_search
from tidewater.plans.base import Lake, query

# SQL of the analyser without stemming.
_STOP = ", ".join(f"'{w}'" for w in analyse.STOP_WORDS)
TOKENS = f"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({{0}}, ''), '\\[[A-Z_]+\\]', ' ', 'g')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"
_DOCS = f"d AS (SELECT doc_id AS id, text, {TOKENS.format('text')} AS w FROM documents)"
_IX = "ix AS (SELECT id, lexeme, len(w) AS doc_len, count(*) AS tf FROM (SELECT id, w, unnest(w) AS lexeme FROM d) GROUP BY ALL), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d)"
_Q = f"q AS (SELECT item_id AS query_id, lexeme FROM (SELECT DISTINCT item_id, unnest({TOKENS.format('text')}) AS lexeme FROM benchmark))"
_BM25 = "df AS (SELECT lexeme, count(*) AS df FROM ix WHERE lexeme IN (SELECT lexeme FROM q) GROUP BY 1), sc AS (SELECT query_id, id, round(sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score FROM ix JOIN df USING (lexeme) JOIN q USING (lexeme), st GROUP BY 1, 2), bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= {0})"
#: The vector side: vector i stands for document i and, for the benchmark's ids, for the question.
_VEC = "vs AS (SELECT query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], x.e), 6) AS score FROM embeddings v, (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) x), vp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= {0})"
_REL = "rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def units(k: Lake) -> DataFrame:
    """Each document as one unit of the index."""
    return k.raw("documents").select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("content"))


def indexed(k: Lake, stemmed: bool = False) -> TextIndex:
    """An index of the documents, written once for the application until their files change."""
    base = scratch(k.spark, "index").rpartition("/")[0]
    state = state_of(k.spark, f"{k.folder}/documents.parquet")
    index = TextIndex(k.spark, f"{base}/index-{k.spark.sparkContext.applicationId}-{stemmed}-{state}", stemmed)
    begun, fine = index.last()
    if not begun or not fine:
        index.refresh(units(k))
    return index


def lexical(k: Lake, pool: int) -> DataFrame:
    index = indexed(k)
    return index.bm25(index.asked(k.raw("benchmark"), "item_id", "text"), pool)


def vector(k: Lake, pool: int) -> DataFrame:
    e = k.raw("embeddings")
    own = e.join(k.raw("benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return exact_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), pool)


def relevant(k: Lake) -> DataFrame:
    """Documents that hold a question's passage word for word."""
    questions = k.raw("benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("array<string>").alias("intents"), F.array("text").alias("needles"))
    docs = k.raw("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("intent"))
    return relevance.relevant(docs, questions, fold=False)


@query("", f"SELECT doc_id, regexp_replace(regexp_replace(text, '[\\w\\.\\-\\+]+@[\\w\\-]+\\.\\w{{2,}}', '[EMAIL]', 'g'), '\\+?\\d{{1,3}}[-\\s]?\\(?\\d{{2,4}}\\)?[-\\s]?\\d{{3,4}}[-\\s]?\\d{{3,4}}', '[PHONE]', 'g') AS masked FROM documents")
def text_mask_email_phone(k: Lake) -> DataFrame:
    return k.raw("documents").select("doc_id", masking.mask_patterns(F.col("text")).alias("masked"))


@query("", "SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN ['the '] ELSE [] END || CASE WHEN contains(lower(text), 'worthless') THEN ['worthless'] ELSE [] END AS leaked FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(text), 'worthless')")
def text_leaks(k: Lake) -> DataFrame:
    """Which known terms a text still holds, without Python: the terms are the policy's few."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in ("the ", "worthless")]), lambda t: t.isNotNull())
    return k.raw("documents").select("doc_id", found.alias("leaked")).where(F.size("leaked") > 0)


@query("", "WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, 0::BIGINT AS ordinal, md5(text) AS content FROM w WHERE len(w) <= 220 UNION ALL SELECT doc_id, i AS ordinal, md5(array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ')) FROM (SELECT doc_id, w, unnest(range(0, ceil((len(w) - 220) / 180.0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 220)")
def text_chunks(k: Lake) -> DataFrame:
    d = k.raw("documents")
    return d.select("doc_id", F.inline(analyse.chunks(F.col("text")))).select("doc_id", "ordinal", F.md5("content").alias("content"))


@query("", f"WITH {_DOCS}, {_IX} SELECT id AS doc_id, lexeme, tf FROM ix")
def text_terms(k: Lake) -> DataFrame:
    return R.terms(k.raw("documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "lexeme", "tf")


@query("", f"WITH {_DOCS}, {_IX}, {_Q}, {_BM25.format(10)} SELECT query_id, id, score, rank FROM bm")
def bm25_topk(k: Lake) -> DataFrame:
    return lexical(k, 10)


@query("", f"WITH {_VEC.format(5)} SELECT query_id, id, score, rank FROM vp")
def vector_topk(k: Lake) -> DataFrame:
    return vector(k, 5)


@query("", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS questions, 5 * (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS neighbours, true AS reached")
def vector_lists_recall(k: Lake) -> DataFrame:
    """Every fiftieth vector against all by coarse lists, held against the exact search: whether 95 of 100 of the five nearest are found."""
    e = k.raw("embeddings")
    vectors, asked = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = VectorIndex(k.spark, scratch(k.spark, "vectors")).build(vectors)
    true = exact_search(vectors, asked, 5)
    hit = true.join(index.search(asked, 5).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("questions"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.95 * F.count("*")).alias("reached"))


_FUSE = "fz AS (SELECT coalesce(bm.query_id, vp.query_id) AS query_id, coalesce(bm.id, vp.id) AS id, bm.rank AS lex_rank, vp.rank AS vec_rank, vp.score AS similarity, round(coalesce(1.0::DOUBLE / (60 + bm.rank), 0) + coalesce(1.0::DOUBLE / (60 + vp.rank), 0), 9) AS score FROM bm FULL JOIN vp ON bm.query_id = vp.query_id AND bm.id = vp.id), fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fz) WHERE rank <= 5)"


@query("", f"WITH {_DOCS}, {_IX}, {_Q}, {_BM25.format(50)}, {_VEC.format(50)}, {_FUSE} SELECT query_id, id, lex_rank, vec_rank, similarity, score, rank FROM fu")
def hybrid_rrf(k: Lake) -> DataFrame:
    return R.fuse(lexical(k, 50), vector(k, 50)).select("query_id", "id", "lex_rank", "vec_rank", "similarity", "score", "rank")


@query("", f"WITH {_DOCS}, {_IX}, {_Q}, {_BM25.format(50)}, {_VEC.format(50)}, {_FUSE} SELECT query_id, coalesce(max(similarity), -1) AS top_similarity, coalesce(max(similarity), -1) < 0.68 AS abstain FROM fu GROUP BY 1")
def retrieval_abstain(k: Lake) -> DataFrame:
    return R.top_similarity(R.fuse(lexical(k, 50), vector(k, 50)))


@query("", f"WITH {_DOCS}, {_IX}, {_Q}, {_BM25.format(5)}, {_REL}, h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM bm SEMI JOIN rel USING (query_id, id) GROUP BY 1), a AS (SELECT DISTINCT query_id FROM rel) SELECT count(*) AS questions, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(hits, 0) / 5.0::DOUBLE), 6) AS precision, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM a LEFT JOIN h USING (query_id)")
def eval_recall_mrr(k: Lake) -> DataFrame:
    return R.evaluate(lexical(k, 5), relevant(k), k.raw("benchmark").select(F.col("item_id").alias("query_id")))


@query("", f"WITH {_REL} SELECT round(avg(1.0::DOUBLE - pow(1.0::DOUBLE - r / (SELECT count(*) FROM documents)::DOUBLE, 5)), 6) AS chance_recall FROM (SELECT query_id, count(*) AS r FROM rel GROUP BY 1)")
def eval_chance(k: Lake) -> DataFrame:
    return R.chance(relevant(k), k.raw("documents").count())


@query(
    "",
    """WITH q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN ['en', 'fr'] WHEN 1 THEN ['en'] END AS intents, list_filter([lower(text[3:30]), lower(text[length(text) - 19:]), CASE WHEN item_id % 2 = 0 THEN 'th' END], lambda x: x IS NOT NULL) AS needles FROM benchmark)
    SELECT query_id, doc_id AS id FROM q, documents d WHERE d.text IS NOT NULL AND (intents IS NULL OR list_contains(intents, lang)) AND len(list_filter(needles, lambda n: NOT contains(lower(d.text), n))) = 0""",
)
def eval_relevance(k: Lake) -> DataFrame:
    """Relevance by label and by all of several needles, parts of words among them."""
    i, t = F.col("item_id"), F.col("text")
    intents = F.when(i % 3 == 0, F.array(F.lit("en"), F.lit("fr"))).when(i % 3 == 1, F.array(F.lit("en")))
    needles = F.array(F.substring(t, 3, 28), F.right(t, F.lit(20)), F.when(i % 2 == 0, F.lit("th")))
    questions = k.raw("benchmark").select(i.alias("query_id"), intents.alias("intents"), needles.alias("needles"))
    return relevance.relevant(k.raw("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("intent")), questions)


_STRATEGIES = {"lexical": ((1.0, 0.0), "lexical"), "vector": ((0.0, 1.0), "vector"), "hybrid": ((1.0, 1.0), None)}


@query(
    "",
    f"""WITH {_DOCS}, {_IX}, {_Q}, {_BM25.format(50)}, {_VEC.format(50)}, {_REL},
    fz AS (SELECT coalesce(bm.query_id, vp.query_id) AS query_id, coalesce(bm.id, vp.id) AS id, bm.rank AS lex_rank, vp.rank AS vec_rank, vp.score AS similarity FROM bm FULL JOIN vp ON bm.query_id = vp.query_id AND bm.id = vp.id),
    s(strategy, wl, wv) AS (VALUES ('lexical', 1.0::DOUBLE, 0.0::DOUBLE), ('vector', 0.0::DOUBLE, 1.0::DOUBLE), ('hybrid', 1.0::DOUBLE, 1.0::DOUBLE)),
    fs AS (SELECT strategy, query_id, id, similarity, round(coalesce(wl / (60 + lex_rank), 0) + coalesce(wv / (60 + vec_rank), 0), 9) AS score FROM fz, s WHERE strategy = 'hybrid' OR strategy = 'lexical' AND lex_rank IS NOT NULL OR strategy = 'vector' AND vec_rank IS NOT NULL),
    fu AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, id) AS rank FROM fs QUALIFY rank <= 5),
    qs AS (SELECT strategy, item_id AS query_id, item_id IN (SELECT query_id FROM rel) AS yes FROM benchmark, s),
    per AS (SELECT qs.strategy, qs.query_id, yes, coalesce(max(similarity), -1) AS top, count(fu.id) AS n, count(rel.id) AS hits, min(rank) FILTER (rel.id IS NOT NULL) AS first FROM qs LEFT JOIN fu ON fu.strategy = qs.strategy AND fu.query_id = qs.query_id LEFT JOIN rel ON rel.query_id = fu.query_id AND rel.id = fu.id GROUP BY 1, 2, 3)
    SELECT strategy, count(*) FILTER (yes) AS answerable, round(coalesce(avg((hits > 0)::INT::DOUBLE) FILTER (yes), 0), 6) AS recall, round(coalesce(avg(hits / greatest(n, 1)::DOUBLE) FILTER (yes), 0), 6) AS precision,
      round(coalesce(avg(coalesce(1.0::DOUBLE / first, 0)) FILTER (yes), 0), 6) AS mrr, CASE WHEN max(top) FILTER (NOT yes) > -1 THEN round(avg((top < 0.68)::INT::DOUBLE) FILTER (NOT yes), 6) END AS abstention_accuracy,
      count(*) FILTER (yes AND top < 0.68) AS false_abstentions, coalesce(min(top) FILTER (yes), 0) AS lowest_answerable, coalesce(max(top) FILTER (NOT yes), 0) AS highest_unanswerable, round(coalesce(min(top) FILTER (yes), 0) - coalesce(max(top) FILTER (NOT yes), 0), 6) AS separation
    FROM per GROUP BY 1""",
)
def eval_measures(k: Lake) -> DataFrame:
    """The six measures of each strategy; a question expects an answer if some document holds its passage."""
    lex, vec, rel = (written(df, n) for df, n in ((lexical(k, 50), "lexical"), (vector(k, 50), "vector"), (relevant(k), "relevant")))
    ranked = None
    for name, (weights, require) in _STRATEGIES.items():
        got = R.fuse(lex, vec, 5, weights, require).select(F.lit(name).alias("strategy"), "query_id", "id", "rank", "similarity")
        ranked = got if ranked is None else ranked.unionByName(got)
    asked = k.raw("benchmark").select(F.col("item_id").alias("query_id")).distinct().join(rel.select("query_id", F.lit(True).alias("yes")).distinct(), "query_id", "left")
    asked = asked.select(F.explode(F.array(*map(F.lit, _STRATEGIES))).alias("strategy"), "query_id", F.coalesce("yes", F.lit(False)).alias("expects_answer"))
    return relevance.measures(ranked, rel, asked)


_QUESTION = "licensed under the apache license idiot worthless for threads"


@query(
    "",
    f"""WITH s AS (SELECT doc_id AS id, unnest(string_split_regex(replace(replace(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(2), ''), chr(3), ''), chr(4), ''), chr(1))) AS sentence, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM documents),
    x AS (SELECT *, round(len(list_intersect(list_distinct({TOKENS.format("sentence")}), list_distinct({TOKENS.format(f"'{_QUESTION}'")}))) / pow(length(sentence)::DOUBLE, 0.25), 6) AS score, lower(trim(sentence)) AS wording FROM s WHERE length(sentence) >= 25),
    a AS (SELECT * FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, id, pos) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY wording ORDER BY score DESC, id, pos) = 1)
    SELECT id, sentence, score FROM b ORDER BY score DESC, id LIMIT 3""",
)
def extractive_sentences(k: Lake) -> DataFrame:
    return R.extract(k.raw("documents"), _QUESTION, "doc_id", "text")


@query("", "WITH i AS (SELECT c_custkey AS ticket_id, 'O' || lpad(CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE c_custkey % 100 END::VARCHAR, 7, '0') AS ref FROM customer), u AS (SELECT ref, min(ticket_id) AS ticket_id FROM i GROUP BY 1 HAVING count(*) = 1), n AS (SELECT *, row_number() OVER (ORDER BY ref) - 1 AS rn, count(*) OVER () AS n FROM u) SELECT ref, ticket_id FROM n WHERE n <= 12 OR rn IN (SELECT floor(j * n / 12.0)::BIGINT FROM generate_series(0, 11) g(j), (SELECT max(n) AS n FROM n))")
def singleton_anchors(k: Lake) -> DataFrame:
    """Ids that one text alone mentions, twelve of them evenly spaced."""
    from tidewater.operators.conform import number_rows

    texts = k.raw("customer").select(F.col("c_custkey").alias("ticket_id"), F.concat(F.lit("see order O"), F.lpad(F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") % 100).cast("string"), 7, "0"), F.lit(".")).alias("t"))
    once = texts.select("ticket_id", F.explode(identifiers(F.col("t"), "O", 7)).alias("ref")).groupBy("ref").agg(F.min("ticket_id").alias("ticket_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    numbered = number_rows(once, ["ref"], "rn")
    n = once.count()
    return numbered.where(F.lit(n <= 12) | (F.col("rn") - 1).isin([j * n // 12 for j in range(12)])).select("ref", "ticket_id")


@query("", "SELECT doc_id AS ticket_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL ORDER BY 1 LIMIT 100")
def enrichment_pending(k: Lake) -> DataFrame:
    """The next hundred documents without enrichment."""
    return k.raw("documents").join(k.raw("labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("ticket_id")).orderBy("ticket_id").limit(100)


@query("", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not json' WHEN quality NOT IN (0, 1) OR toxic NOT IN (0, 1) THEN 'range' END AS error, CASE WHEN doc_id % 5 <> 0 THEN quality::BIGINT END AS quality FROM labels")
def enrichment_parse(k: Lake) -> DataFrame:
    """Fenced JSON replies parsed and checked; errors are told, not raised."""
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("sorry")).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct("quality", "toxic")), F.lit("\n```")))
    plain = F.regexp_replace(body, r"^```(?:json)?\s*|\s*```$", "")
    got = k.raw("labels").select("doc_id", F.from_json(plain, "quality bigint, toxic bigint").alias("j"))
    bad = F.col("j.quality").isNull() & F.col("j.toxic").isNull()
    error = F.when(bad, "not json").when(~F.col("j.quality").isin(0, 1) | ~F.col("j.toxic").isin(0, 1), "range")
    return got.select("doc_id", error.alias("error"), F.col("j.quality").alias("quality"))


def refreshed(k: Lake) -> TextIndex:
    """An index of an older state of the documents (a third not there yet, a seventh with another text, as many more that are gone since), brought up to date."""
    index = TextIndex(k.spark, scratch(k.spark, "index"), stemmed=False)
    d = units(k)
    stale = F.concat(F.coalesce("content", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit(" stale words of an older text")).otherwise(F.lit("")))
    older = d.where("doc_id % 3 <> 0").withColumn("content", stale)
    gone = d.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), (F.col("id") + 1_000_000_000_000).alias("id"), "content")
    index.refresh(older.union(gone))
    index.refresh(d)
    return index


@query("", f"WITH {_DOCS}, {_IX} SELECT id AS doc_id, lexeme, tf, doc_len FROM ix")
def index_refresh_postings(k: Lake) -> DataFrame:
    """The postings of an index that was refreshed; the SQL builds them from nothing."""
    return refreshed(k).postings().select(F.col("id").alias("doc_id"), "lexeme", "tf", "doc_len")


@query("", f"WITH {_DOCS}, {_IX} SELECT lexeme, count(*) AS df FROM ix GROUP BY 1")
def index_refresh_frequencies(k: Lake) -> DataFrame:
    """Document frequencies as sums of signed changes; the SQL counts them."""
    return refreshed(k).frequencies()


@query("", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.h IS NULL THEN 'orphan' WHEN b.h IS NULL THEN 'new' ELSE 'changed' END AS action FROM (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT doc_id AS id, md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 3 <> 0) b ON a.id = b.id WHERE a.h IS DISTINCT FROM b.h")
def index_incremental(k: Lake) -> DataFrame:
    """What an incremental index run has to do: chunks new, changed or gone; equal content hashes are skipped."""
    d = k.raw("documents")
    now = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    old = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.md5(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("g"))
    both = now.join(old, "id", "full").where(~F.col("h").eqNullSafe(F.col("g")))
    return both.select("id", F.when(F.col("h").isNull(), "orphan").when(F.col("g").isNull(), "new").otherwise("changed").alias("action"))
