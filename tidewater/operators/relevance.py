"""What counts as an answer, found by an equi-join, and the six measures of a retrieval.

A document is relevant to a question if its label is one of the question's
intents and its text holds every needle. Texts and needles are never compared
all with all: of the grams of a question's needles (up to three whole words
inside a needle, else a few characters) the one that fewest documents hold is
looked up, and what it finds is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import retrieval
from tidewater.operators.materialise import written

#: Neighbours of a gram at most. Kinds go up with what they tell: 1 to CHARS characters, then 1 to WORDS words.
WORDS, CHARS = 3, 5
#: Grams of questions and ids of candidates that are broadcast at most; beyond, documents are shuffled by them.
FEW = 1_000_000


def split(text: Column, kind: int) -> Column:
    return F.split(text, "") if kind <= CHARS else F.split(text, r"\s+")


def neighbours(df: DataFrame, parts: str, kind: int, *keep: str) -> DataFrame:
    """``(*keep, kind, gram)`` for every run of neighbours in the array ``parts``, as many as the kind has."""
    n, glue = (kind, "") if kind <= CHARS else (kind - CHARS, " ")
    size = F.greatest(F.size(parts) - (n - 1), F.lit(0))
    rows = df.where(F.size(parts) >= n).select(*keep, F.explode(F.arrays_zip(*[F.slice(parts, i + 1, size).alias(f"p{i}") for i in range(n)])).alias("s"))
    return rows.select(*keep, F.lit(kind).alias("kind"), F.concat_ws(glue, *[F.col(f"s.p{i}") for i in range(n)]).alias("gram"))


def question_grams(needles: DataFrame) -> DataFrame:
    """``(query_id, kind, gram)`` for ``(query_id, n)``: grams that any text with the needle has.

    Words between a needle's first and last are whole words there, too; needles of
    one or two words give characters. Of a question only its highest kind stays.
    """
    words = split(F.col("n"), CHARS + 1)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    kind = F.when(F.size(words) > 2, F.least(F.size(words) - 2, F.lit(WORDS)) + CHARS).otherwise(F.least(F.length("n"), F.lit(CHARS)))
    cut = needles.select("query_id", F.when(F.size(words) > 2, inner).otherwise(split(F.col("n"), 1)).alias("parts"), kind.alias("of"))
    cut = written(cut, "needles")
    top = cut.groupBy("query_id").agg(F.max("of").alias("top"))
    cut = cut.join(top, "query_id").where("of = top")
    out = None
    for k in sorted(r[0] for r in top.select("top").distinct().collect()):  # CHARS + WORDS at most
        rows = neighbours(cut.where(F.col("of") == k), "parts", k, "query_id")
        out = rows if out is None else out.union(rows)
    return needles.select("query_id", F.lit(0).alias("kind"), F.lit("").alias("gram")).limit(0) if out is None else out.distinct()


def relevant(docs: DataFrame, questions: DataFrame, fold: bool = True) -> DataFrame:
    """``(query_id, id)`` for ``docs(id, text, intent)`` and ``questions(query_id, intents, needles)``.

    ``intents`` null: any; ``needles`` null or empty: the label alone decides.
    ``fold`` compares lower-cased. Null texts hold nothing; null and empty
    needles are held by all; a question that asks for nothing at all finds
    nothing. Repeated rows count once.
    """
    low = F.lower if fold else (lambda c: c)
    q = questions.select("query_id", "intents", F.array_distinct(F.filter(F.transform(F.coalesce("needles", F.array().cast("array<string>")), low), lambda n: n.isNotNull() & (n != ""))).alias("needles")).distinct()
    q = written(q, "questions")
    held = q.where(F.size("needles") > 0)
    grams = written(question_grams(held.select("query_id", F.explode("needles").alias("n"))), "needle_grams")
    kinds = sorted(r[0] for r in grams.select("kind").distinct().collect())  # CHARS + WORDS at most
    text = low(F.col("text"))
    d = docs.select("id", "text", "intent").where("text IS NOT NULL")
    asked = grams.select("kind", "gram").distinct()
    asked = F.broadcast(asked) if asked.count() <= FEW else asked
    seen = None
    for k in kinds:
        rows = neighbours(d.select("id", split(text, k).alias("parts")), "parts", k, "id").join(asked, ["kind", "gram"], "left_semi")
        seen = rows if seen is None else seen.union(rows)
    if seen is None:
        found = d.join(held.select("query_id"), F.lit(False)).select("query_id", "id")
    else:
        seen = written(seen.distinct(), "seen_grams")
        df = seen.groupBy("kind", "gram").agg(F.count("*").alias("df"))
        rarest = grams.join(df, ["kind", "gram"], "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "kind", "gram")).alias("r")).select("query_id", "r.kind", "r.gram")
        pairs = written(rarest.join(seen, ["kind", "gram"]).select("query_id", "id"), "candidates")
        labelled = F.col("intents").isNull() | F.array_contains("intents", F.col("intent"))
        ids = written(pairs.select("id").distinct(), "candidate_ids")
        ids = F.broadcast(ids) if ids.count() <= FEW else ids
        # texts of candidates alone are shuffled
        both = pairs.join(held, "query_id").join(d.join(ids, "id", "left_semi").select("id", text.alias("low"), "intent"), "id").where(labelled)
        each = both.select("query_id", "id", F.size("needles").alias("of"), "low", F.explode("needles").alias("n")).where(F.contains("low", F.col("n")))
        # rows of one id and different texts are judged apart
        found = each.groupBy("query_id", "id", F.xxhash64("low"), "of").agg(F.count_distinct("n").alias("held")).where("held = of").select("query_id", "id")
    plain = q.where((F.size("needles") == 0) & F.col("intents").isNotNull()).select("query_id", F.explode("intents").alias("intent"))
    by_label = docs.select("id", "intent").join(plain, "intent").select("query_id", "id")
    return found.union(by_label).distinct()


def unmatched(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions that no document answers: their recall could only be zero, which says nothing of the retrieval."""
    return questions.select("query_id").join(found, "query_id", "left_anti")


def measures(ranked: DataFrame, answers: DataFrame, questions: DataFrame, by: str = "strategy", threshold: float = retrieval.ABSTAIN) -> DataFrame:
    """One row a strategy for ``ranked(by, query_id, id, rank, similarity)`` and ``questions(by, query_id, expects_answer)``.

    Over questions that expect an answer: ``recall`` (any relevant), ``precision``
    (relevant of those returned), ``mrr``, ``false_abstentions``, ``lowest_answerable``
    similarity. Over the others: ``abstention_accuracy`` (null if no similarity
    is known for any, as for lexical results: then nothing was judged) and
    ``highest_unanswerable``. ``separation`` is the gap between the two; no
    threshold tells them apart if it is negative.
    """
    marked = ranked.join(answers.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    each = marked.groupBy(by, "query_id").agg(F.max("similarity").alias("top"), F.count("*").alias("n"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    per = questions.join(each, [by, "query_id"], "left").withColumn("top", F.coalesce("top", F.lit(-1.0)))
    yes, no = F.col("expects_answer"), ~F.col("expects_answer")
    abstains = F.col("top") < threshold
    mean = lambda cond, c: F.round(F.coalesce(F.avg(F.when(cond, c)), F.lit(0.0)), 6)
    known = F.max(F.when(no, F.col("top"))) > -1.0
    low, high = F.coalesce(F.min(F.when(yes, F.col("top"))), F.lit(0.0)), F.coalesce(F.max(F.when(no, F.col("top"))), F.lit(0.0))
    return per.groupBy(by).agg(
        F.count_if(yes).alias("answerable"),
        mean(yes, F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("recall"),
        mean(yes, F.coalesce(F.col("hits") / F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(0.0))).alias("precision"),
        mean(yes, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(known, F.round(F.avg(F.when(no, F.when(abstains, 1.0).otherwise(0.0))), 6)).alias("abstention_accuracy"),
        F.count_if(yes & abstains).alias("false_abstentions"),
        low.alias("lowest_answerable"),
        high.alias("highest_unanswerable"),
        F.round(low - high, 6).alias("separation"),
    )
