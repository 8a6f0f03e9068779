"""TF-IDF classifiers on Spark ML: shared features, four classifiers, scoring, saving, cross-validation."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.rewrites import second_pass
from tidelog.functions.scoring import displayed_confidence, label_or_anomaly, risk_score, softmax_confidence
from tidelog.operators import folds, metrics, segments
from tidelog.operators.joins import lookup_join
from tidelog.operators.sampling import stratified_folds
from tidelog.operators.squared_hinge import SquaredHingeClassifier
from tidelog.operators.terms import TOKEN, doc_terms, tasks
from tidelog.session import materialize

MODEL_NAMES = ["naive_bayes", "random_forest", "logreg", "linearsvc"]
DEFAULT_MODEL = "linearsvc"
EVERY_TERM = (1 << 31) - 1  # of a vocabulary without a caller's limit
MAX_ITERATIONS = 2000


def _tokens_sql(text: str) -> str:
    pattern = TOKEN.replace("\\", "\\\\")
    return f"SELECT *, regexp_extract_all(lower({text}), '{pattern}', 0) AS _words FROM __THIS__"


_TERMS = (
    "SELECT *, concat(_words, zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)), "
    "slice(_words, 2, greatest(size(_words) - 1, 0)), (a, b) -> concat(a, ' ', b))) AS _terms FROM __THIS__"
)


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts to 1 + ln(count), on the stored entries only."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.arrow_udf(VectorUDT())
        def log_counts(v: pa.Array) -> pa.Array:
            offsets = np.append(0, np.cumsum(v.field("values").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
            logs = 1.0 + np.log(pc.list_flatten(v.field("values")).to_numpy(zero_copy_only=False))
            counts = [v.field("type"), v.field("size"), v.field("indices"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(logs), v.type.field("values").type)]
            return pa.StructArray.from_arrays(counts, fields=list(v.type))

        return dataset.withColumn(self.getOutputCol(), log_counts(F.unwrap_udt(F.col(self.getInputCol()))))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol):
    """Spark's IDF plus one. The fitted stage is a plain element-wise product."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        fitted = IDF(inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset)
        return ElementwiseProduct(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            scalingVec=Vectors.dense(fitted.idf.toArray() + 1.0),
        )


def fit_features(
    train: DataFrame, text: str, max_features: int = EVERY_TERM, sublinear: bool = False
) -> PipelineModel:
    """Unigram and bigram TF-IDF vectors in column ``features``; terms in two documents or more."""
    stages: list[Transformer] = []
    current = train.select(text)

    def add(stage: Transformer) -> None:
        nonlocal current
        stages.append(stage)
        current = stage.transform(current)

    add(SQLTransformer(statement=_tokens_sql(text)))
    add(SQLTransformer(statement=_TERMS))
    add(CountVectorizer(inputCol="_terms", outputCol="_counts", minDF=2.0, vocabSize=max_features).fit(current))
    counts = "_counts"
    if sublinear:
        add(LogCounts(inputCol="_counts", outputCol="_log_counts"))
        counts = "_log_counts"
    add(SmoothIdf(inputCol=counts, outputCol="_weighted").fit(current))
    add(Normalizer(inputCol="_weighted", outputCol="features", p=2.0))
    return PipelineModel(stages)


def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    """Label index by ``classes`` order is expected in ``label``; the weights are one row per label."""
    from tidelog.operators.terms import class_weights

    weights = class_weights(train, label).select(label, "class_weight")
    return train.join(F.broadcast(weights), label)


def classifier(name: str, rows: int, trees: int = 100, depth: int = 30, seed: int = 42) -> Estimator:
    """An unfitted classifier. ``rows`` sets the logistic penalty: cost 1 per row is 1/rows per mean row."""
    if name == "naive_bayes":
        return NaiveBayes(modelType="complement", smoothing=1.0)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="class_weight", seed=seed)
    if name == "logreg":
        return LogisticRegression(
            family="multinomial", weightCol="class_weight", standardization=False, regParam=1.0 / max(rows, 1), maxIter=MAX_ITERATIONS
        )
    if name == "linearsvc":
        return SquaredHingeClassifier()
    raise ValueError(f"unknown classifier: {name}")


def train_models(
    train: DataFrame,
    text: str = "template",
    label: str = "label",
    classes: list[str] = sorted(V.LABELS),
    names: list[str] = MODEL_NAMES,
    max_features: int = EVERY_TERM,
    sublinear: bool = False,
    **options: int,
) -> dict[str, PipelineModel]:
    """One fitted pipeline per name; the features are fitted once and shared."""
    features = fit_features(train, text, max_features, sublinear)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    vectors = features.transform(train).select("features", index.cast("double").alias("label"))
    frame = materialize(with_class_weight(vectors, "label"), "training")
    rows = frame.count()
    back = IndexToString(inputCol="prediction", outputCol="best", labels=classes)
    return {
        name: PipelineModel([*features.stages, classifier(name, rows, **options).fit(frame), back])
        for name in names
    }


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_model(folder: str, name: str = DEFAULT_MODEL) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}")


def predict(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``best`` and ``scores``; helper columns are dropped."""
    scored = model.transform(rows).withColumn("scores", vector_to_array("rawPrediction"))
    return scored.select(*rows.columns, "best", "scores")


def score_events(
    events: DataFrame, model: PipelineModel, threshold: float = V.OOD_THRESHOLD, second: bool = True
) -> DataFrame:
    """Add predicted_label, confidence and risk_score to events with ``id`` and ``template``.

    Templates repeat a lot, so each distinct one is scored once; they are counted before the shuffle.
    The model was trained on templates of the second pass, so they get it here too, unless ``second``
    is false. Scores are joined back by template; a hot template stays spread over tasks.
    """
    counted = events.filter("template is not null").groupBy("template").agg(F.count("*").alias("_n"))
    text = second_pass(F.col("template")) if second else F.col("template")
    distinct = counted.select(F.col("template").alias("_seen"), F.coalesce(text, F.lit("")).alias("template"), "_n")
    confidence = softmax_confidence(F.col("scores"))
    label = label_or_anomaly(F.col("best"), F.col("_c"), threshold)
    scored = (
        predict(distinct, model)
        .withColumn("_c", confidence)
        .select(
            F.col("_seen").alias("template"),
            "_n",
            label.alias("predicted_label"),
            displayed_confidence(F.col("_c")).alias("confidence"),
        )
        .withColumn("risk_score", risk_score(F.col("predicted_label")))
    )
    return lookup_join(events, materialize(scored, "scored-templates"), "template", ["id"], "_n", "left")


def evaluate_models(test: DataFrame, models: dict[str, PipelineModel], text: str = "template", label: str = "label") -> DataFrame:
    """Comparison rows (model, accuracy, macro_f1, ...) on one test set."""
    parts = [
        predict(test.select(text, F.col(label).alias("y_true")), model).select(
            F.lit(name).alias("model"), "y_true", F.col("best").alias("y_pred")
        )
        for name, model in models.items()
    ]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    return metrics.metrics_rows(pairs, ["model"])


def best_report(
    train: DataFrame, test: DataFrame, comparison: DataFrame, score: str = "macro_f1", text: str = "template", label: str = "label", **options
) -> DataFrame:
    """Refit the best of our own models in ``comparison`` and report it per class."""
    own = comparison.filter(F.col("model").isin(MODEL_NAMES))
    name = own.orderBy(F.desc(score), F.asc("model")).first()["model"]
    model = train_models(train, text, label, names=[name], **options)[name]
    pairs = predict(test.select(text, F.col(label).alias("y_true")), model).select("y_true", F.col("best").alias("y_pred"))
    return metrics.per_class(metrics.confusion_counts(pairs)).withColumn("model", F.lit(name))


def cross_validate(
    df: DataFrame,
    key: str,
    text: str = "template",
    label: str = "label",
    k: int = 5,
    names: list[str] = MODEL_NAMES,
    classes: list[str] = sorted(V.LABELS),
    max_features: int | None = None,
    sublinear: bool = False,
    **options,
) -> DataFrame:
    """Macro F1 per model over ``k`` stratified folds: mean, std, range and the fold list. ``key`` is unique.

    Texts are counted once for all folds, for complement Bayes where its terms meet and for the other models in a stored table;
    the vocabulary of each training part is that of all rows less its fold (``folds``).
    """
    folded = materialize(stratified_folds(df.select(*dict.fromkeys([key, text, label])), key, label, k), "folds")
    sizes = {int(r["fold"]): r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = folded.select(F.col(key).alias("doc_id"), F.col("fold").cast("int").alias("fold"), F.col(label).alias("_label"), index.cast("double").alias("label"))
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=classes)
    truth = IndexToString(inputCol="label", outputCol="y_true", labels=classes)
    pairs = []
    if "naive_bayes" in names and max_features is None and not sublinear:
        truths = rows.select("doc_id", "fold", F.col("_label").alias("label"))
        docs = folded.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col("fold").cast("int").alias("fold"), F.col(label).alias("label"))
        partitions = tasks(docs)
        found = folds.bayes_pairs_by_term(doc_terms(docs, partitions, ("fold", "label")), sizes, truths, classes, partitions)
        pairs.append(found.select(F.lit("naive_bayes").alias("model"), "fold", "y_true", "y_pred"))
        names = [name for name in names if name != "naive_bayes"]
    if names:
        counts = folds.fold_counts(folded, key, text)
        vocabularies = materialize(folds.fold_vocabularies(counts, sizes), "fold-vocabularies")
    for fold in sizes if names else ():
        own = vocabularies.filter(F.col("held") == fold).select("term", "df", "cf", "idf")
        if max_features is not None:
            own = own.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
        own = segments.with_index(own)
        train, test = (
            segments.session_features(counts.select("doc_id", "term", "tf"), rows.filter(part).select("doc_id", "label"), "doc_id", own, sublinear=sublinear)
            for part in (F.col("fold") != fold, F.col("fold") == fold)
        )
        weighted = materialize(with_class_weight(train, "label"), "training")
        n = weighted.count()
        for name in names:
            scored = truth.transform(back.transform(classifier(name, n, **options).fit(weighted).transform(test)))
            pairs.append(scored.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "y_true", "y_pred"))
    metric = metrics.metrics_rows(reduce(DataFrame.unionByName, pairs), ["model", "fold"], digits=None)
    return metrics.crossval_summary(metric.select("model", "fold", "macro_f1"))
