"""File catalogues, guarded reads and sinks of grid tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_of_name(name: Column, first_year: int, first_month: int = 1) -> Column:
    """Month index of a file name: ``YYYYMM.ext`` counts from the first month, ``N.ext`` is the index itself; else null."""
    stem = F.regexp_extract(name, r"([^/]*?)\.[^./]*$", 1)
    year, month = F.substring(stem, 1, 4).try_cast("int"), F.substring(stem, 5, 2).try_cast("int")
    dated = F.when(month.between(1, 12), (year - first_year) * 12 + month - first_month)
    return F.when(stem.rlike("^[0-9]{6}$"), dated).when(stem.rlike("^[0-9]{1,5}$"), stem.try_cast("int"))


def with_month(df: DataFrame, first_year: int) -> DataFrame:
    """Rows read from monthly files, with the month of their file; rows of other files are left out."""
    return df.withColumn("t", month_of_name(F.col("_metadata.file_name"), first_year)).where("t is not null")


def monthly_cells(rows: DataFrame, first_year: int, months: tuple[int, int], lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells (i, j, lat, lon, value) of monthly files on every month of ``months``: rows of files without a month in
    their name or outside are left out, cells are clipped to the box, and absent months are null."""
    from ..operators.grid import clip_box

    x = clip_box(with_month(rows, first_year).where(F.col("t").between(*months)), lat, lon)
    spine = rows.sparkSession.range(months[0], months[1] + 1).select(F.col("id").cast("int").alias("t"))  # the month axis
    return x.select("i", "j", "lat", "lon").distinct().crossJoin(F.broadcast(spine)).join(x.select("t", "i", "j", "value"), ["t", "i", "j"], "left")


def resolve(columns: list[str], candidates: list[str]) -> str:
    """The first candidate among the columns."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"none of {candidates} in {columns}")


def scale_or_one(spark: SparkSession, path: str | None, cells: DataFrame) -> DataFrame:
    """(i, j, scale_factor, scaled): the factors at ``path``, or 1.0 and ``scaled`` false where there are none."""
    if path:
        try:
            found = spark.read.parquet(path).select("i", "j", "scale_factor")
            return cells.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("scale_factor", F.lit(1.0)).alias("scale_factor"), F.col("scale_factor").isNotNull().alias("scaled"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return cells.select("i", "j", F.lit(1.0).alias("scale_factor"), F.lit(False).alias("scaled"))


def cv_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-model result files ``<model>_cv_results.csv``, with the model from the file name."""
    x = spark.read.csv(pattern, header=True, schema="fold int, n_train long, n_test long, r2 double, rmse double, mae double")
    return x.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_cv_results\.csv$", 1))


def save_grid(df: DataFrame, path: str, title: str, step: str, first_year: int) -> None:
    """Floats as float32, partitioned by year, with title and step in the column metadata."""
    told = {"title": title, "step": step}
    narrow = [F.col(n).cast("float").alias(n, metadata=told) if t == "double" else F.col(n).alias(n, metadata=told) for n, t in df.dtypes]
    df.select(*narrow, (F.floor(F.col("t") / 12) + first_year).cast("int").alias("year")).write.mode("overwrite").partitionBy("year").parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)  # metric tables have a few rows


def save_tuned(best: DataFrame, path: str) -> None:
    """Best parameters (model, value, params) as JSON lines, one for each model."""
    best.select("model", "value", "params").coalesce(1).write.mode("overwrite").json(path)


def load_tuned(spark: SparkSession, path: str | None) -> dict[str, dict[str, str]]:
    """Tuned parameters by model; empty where none were saved."""
    if not path:
        return {}
    try:
        saved = spark.read.schema("model string, value double, params map<string,string>").json(path)
        return {r.model: r.params for r in saved.collect()}  # a row for each model
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def with_tuned(defaults: dict[str, dict], tuned: dict[str, dict]) -> dict[str, dict]:
    """Parameters by model: the tuned ones where there are some, over the defaults."""
    return {m: {**p, **tuned.get(m, {})} for m, p in defaults.items()} | {m: p for m, p in tuned.items() if m not in defaults}


def catalogue(files: DataFrame, months: DataFrame, first_year: int) -> DataFrame:
    """(source, variable, t, file) for every source, variable and month: ``files`` (source, variable, file) by the month
    of their names, on the month spine (t); the file of an absent month is null."""
    named = files.withColumn("t", month_of_name(F.col("file"), first_year)).where("t is not null").groupBy("source", "variable", "t").agg(F.max("file").alias("file"))
    spine = files.select("source", "variable").distinct().crossJoin(F.broadcast(months.select("t").distinct()))  # the month axis
    return spine.join(named, ["source", "variable", "t"], "left")


def save_run_info(spark: SparkSession, path: str, title: str, step: str, seed: int) -> None:
    """A row that tells what wrote a table: title, step, date and seed."""
    spark.range(1).select(F.lit(title).alias("title"), F.lit(step).alias("step"), F.current_date().alias("date"), F.lit(seed).alias("seed")).write.mode("append").parquet(path)


def save_cv(results: DataFrame, path: str) -> None:
    """Fold results as one CSV file for each model, under the model's name."""
    results.repartition("model").write.mode("overwrite").partitionBy("model").csv(path, header=True)


def months_stored(spark: SparkSession, path: str, expected: int, share: float = 0.95) -> bool:
    """Whether the table at ``path`` has enough of the expected months to be used again."""
    try:
        return spark.read.parquet(path).select("t").distinct().count() >= share * expected
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return False
    return True


def _marks(df: DataFrame, by: list[str]) -> DataFrame:
    """Number of rows and sum of their hashes, which no order of rows changes."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("h"))


def fingerprint(*tables: DataFrame) -> str:
    """What tells whether tables hold the same rows as before: one aggregation each."""
    return " ".join(f"{r['n']}:{r['h']}" for r in (_marks(t, []).first() for t in tables))


def is_current(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the table at ``path`` was made from inputs of this fingerprint."""
    return exists(spark, path) and exists(spark, f"{path}.mark") and spark.read.parquet(f"{path}.mark").first()["mark"] == mark


def save_months(df: DataFrame, path: str, mark: str) -> list[int]:
    """Stores a table with a month ``t``, in a folder for each month, and the fingerprint of what it was made from. Only
    months that differ from what is stored are rewritten; returns them. The mark is written last, so a save that is
    interrupted is done again."""
    from .scratch import Written

    spark, months = df.sparkSession, f"{path}.months"
    new = Written(df)
    marks = _marks(new.table, ["t"])
    changed = [r["t"] for r in marks.select("t").collect()]  # the month axis
    whole = True
    if exists(spark, path) and exists(spark, months):
        old = spark.read.parquet(months).toDF("t", "n0", "h0")
        both = marks.join(old, "t", "full_outer").where("not (n <=> n0 and h <=> h0)").select("t", F.col("n").isNull().alias("gone")).collect()
        whole = any(r["gone"] for r in both) or sorted(spark.read.parquet(path).columns) != sorted(new.table.columns)
        changed = changed if whole else [r["t"] for r in both]
    if changed:
        out = new.table if whole else new.table.where(F.col("t").isin(changed))
        out.repartition("t").write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("t").parquet(path)
    marks.coalesce(1).write.mode("overwrite").parquet(months)
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}.mark")
    new.drop()
    return sorted(changed)


def save_models(models: dict, path: str, ensemble: DataFrame | None = None) -> None:
    """Fitted models under their names, each by its own writer, with the kind that tells how to read it again."""
    spark = SparkSession.active()
    for name, model in models.items():
        if hasattr(model, "save") and hasattr(type(model), "load") and not hasattr(model, "write"):
            model.save(spark, f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(n, type(m).__name__) for n, m in models.items()], "model string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    if ensemble is not None:
        ensemble.select("model", "weight").write.mode("overwrite").parquet(f"{path}/ensemble")


def save_attributions(phi: DataFrame, path: str) -> None:
    phi.select("model", "sample_id", "feature", "x", "phi").write.mode("overwrite").partitionBy("model").parquet(path)


def load_attributions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Saved attributions, of some models or of all."""
    x = spark.read.parquet(path)
    return x.where(F.col("model").isin(models)) if models else x


def load_models(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[dict, dict[str, float]]:
    """Fitted models by name, those named or all that were saved, and ensemble weights (empty where none were saved)."""
    from pyspark.ml import PipelineModel

    from ..operators.boost import BoostModel
    from ..operators.gradient import Network

    kinds = {r.model: r.kind for r in spark.read.parquet(f"{path}/names").collect()}  # a row for each model
    try:
        weights = {r.model: r.weight for r in spark.read.parquet(f"{path}/ensemble").collect()}  # a row for each model
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        weights = {}
    own = {"BoostModel": BoostModel, "Network": Network}
    read = lambda n: own[kinds[n]].load(spark, f"{path}/{n}") if kinds[n] in own else PipelineModel.load(f"{path}/{n}")
    return {n: read(n) for n in names or kinds}, weights
