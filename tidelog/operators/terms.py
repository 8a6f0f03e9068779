"""Unigram and bigram TF-IDF as tables.

``documents`` is (doc_id, text). Weighted terms are (doc_id, term, tf, w). The vocabulary
(term, df, cf, idf) is written once, as it is part of the model and is read by training and scoring.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.joins import lookup_join
from tidelog.session import materialize

TOKEN = r"[\p{L}\p{N}_]{2,}"
TASK_BYTES = 16 << 20  # of text


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bigrams(words: Column) -> Column:
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    second = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))


def tasks(documents: DataFrame, text: str = "text") -> int:
    """Partitions for the terms of ``documents``: sixteen megabytes of text each, and the session's number at least."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def doc_terms(documents: DataFrame, partitions: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, term, tf): counts. ``also`` are columns that ``doc_id`` decides; they are kept.

    A document's terms are sorted and its runs counted within its row, so a task holds one document at a time and not a table of
    all its terms. Texts are spread by document before; nothing later that goes by document needs a further shuffle of the much
    larger term rows. The outer generator spares the filter on the size of its array, which would count each document twice.
    """
    spread = documents.select("doc_id", "text", *also)
    return _terms_of(spread.repartition(partitions or tasks(documents), "doc_id"), also)


def _terms_of(spread: DataFrame, also: tuple[str, ...]) -> DataFrame:
    """``doc_terms`` of rows of which those of a document lie in one task."""
    texts = spread.groupBy("doc_id", *also).agg(F.collect_list("text").alias("_texts"))  # one, where ids are unique
    words = F.transform("_texts", tokens)
    terms = F.sort_array(F.flatten(F.transform(words, lambda w: F.concat(w, bigrams(w)))))
    counted = texts.select("doc_id", *also, terms.alias("_t"))
    places = F.sequence(F.lit(1), F.size("_t"))
    ends = F.filter(places, lambda i: ~F.get("_t", i - 1).eqNullSafe(F.get("_t", i)))
    counted = counted.select("doc_id", *also, "_t", F.when(F.size("_t") > 0, ends).alias("_ends"))
    start = lambda i: F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)
    pairs = F.transform("_ends", lambda end, i: F.struct(F.get("_t", end - 1).alias("term"), (end - start(i)).cast("long").alias("tf")))
    return counted.select("doc_id", *also, F.inline_outer(pairs)).filter("term is not null")


def term_sums(documents: DataFrame) -> DataFrame:
    """(term, df, cf): in how many documents a term is, and how often.

    Terms are summed inside the tasks of their documents first, which takes no shuffle as the task is a column; the sums then go to as
    many tasks as the text asks for, so that neither a frequent term nor the number of different ones fills a task.
    """
    partitions = tasks(documents)
    task = F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int")
    spread = documents.select("doc_id", "text", task.alias("_task")).repartitionById(partitions, "_task")
    inside = _terms_of(spread, ("_task",)).groupBy("_task", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return inside.select("term", "df", "cf").repartition(partitions, "term").groupBy("term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"), F.sum("cf").alias("cf"))


def vocabulary_of(counts: DataFrame, n: int, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(term, df, cf, idf) from the term counts (doc_id, term, tf) of ``n`` documents."""
    return _weighed(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), n, min_df, max_features)


def _weighed(sums: DataFrame, n: int, min_df: int, max_features: int | None) -> DataFrame:
    frequent = sums.filter(F.col("df") >= min_df)
    if max_features is not None:
        frequent = frequent.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return frequent.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def fit_vocabulary(
    documents: DataFrame, min_df: int = 2, max_features: int | None = None, keep: bool = True
) -> DataFrame:
    """(term, df, cf, idf), idf = ln((1 + n) / (1 + df)) + 1, for terms in ``min_df`` documents or more.

    ``max_features`` keeps the terms with the highest corpus count.
    """
    n = documents.agg(F.count("*")).scalar()
    vocabulary = _weighed(term_sums(documents), n, min_df, max_features)
    return materialize(vocabulary, "vocabulary") if keep else vocabulary


def weigh(counts: DataFrame, vocabulary: DataFrame, sublinear: bool = False) -> DataFrame:
    """(doc_id, term, tf, w) of term counts: tf (or 1 + ln(tf)) * idf with each document scaled to length one."""
    if sublinear:
        counts = counts.withColumn("tf", 1 + F.log("tf"))
    known = lookup_join(counts, vocabulary.select("term", "idf", "df"), "term", ["doc_id"], "df")
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("doc_id")))
    return known.select("doc_id", "term", "tf", (raw / length).alias("w"))


def vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, indices, values) of documents with a known term: the weights of ``weigh`` by the vocabulary's ``index``, in its order.

    Terms meet the vocabulary once and only numbers go on to the documents.
    """
    known = lookup_join(counts, vocabulary.select("term", "index", "idf", "df"), "term", ["doc_id"], "df")
    x = F.col("tf") * F.col("idf")
    entries = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", x.alias("x")))).alias("e"), F.sqrt(F.sum(x * x)).alias("l"))  # one document's terms
    return entries.select("doc_id", F.col("e.index").alias("indices"), F.transform("e.x", lambda x: x / F.col("l")).alias("values"))


def tfidf(documents: DataFrame, vocabulary: DataFrame, sublinear: bool = False) -> DataFrame:
    """(doc_id, term, tf, w): tf * idf with each document scaled to length one."""
    return weigh(doc_terms(documents), vocabulary, sublinear)


def placed_terms(documents: DataFrame, n: Column, min_df: int = 2, sublinear: bool = False, known: str | None = None) -> DataFrame:
    """(doc_id, ``known``, term, df, x), x = tf (or 1 + ln(tf)) * idf: the terms of documents under their own vocabulary.

    Counts go once to the tasks of their terms, where the document frequency is a count over the rows themselves: no vocabulary
    is written and none joined. Rows are sorted before they are sent, so equal terms lie together and are packed well. The
    vocabulary is that of the ``n`` documents whose column ``known`` is not null, of all without that name.
    """
    partitions, also = tasks(documents), (known,) if known else ()
    counts = doc_terms(documents, partitions, also).sortWithinPartitions("term").repartition(partitions, "term")
    frequency = F.count(known or "*").over(Window.partitionBy("term"))
    frequent = counts.withColumn("df", frequency).filter(F.col("df") >= min_df)
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    return frequent.select("doc_id", *also, "term", "df", ((1 + F.log("tf") if sublinear else F.col("tf")) * idf).alias("x"))


def own_tfidf(documents: DataFrame, sublinear: bool = False) -> DataFrame:
    """(doc_id, term, w): what ``tfidf`` gives under the vocabulary of the same documents, in one pass over their texts."""
    n = documents.agg(F.count("*")).scalar()
    rows = placed_terms(documents, n, sublinear=sublinear).select("doc_id", "term", "x")
    rows = rows.repartition(tasks(documents), "doc_id")
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "term", (F.col("x") / length).alias("w"))


def class_weights(labeled: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per label: n / (labels * rows of the label)."""
    per_label = labeled.groupBy(label).agg(F.count("*").alias("n"))
    everywhere = Window.partitionBy(F.lit(0))
    total, kinds = F.sum("n").over(everywhere), F.count("*").over(everywhere)
    return per_label.select(label, "n", (total / (kinds * F.col("n"))).alias("class_weight"))
