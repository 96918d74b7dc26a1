"""Language-model, lexicon, alignment, lattice and list files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import dense_index
from .segments import file_lines, lines_below

#: Text for probability zero, and the values that stand for it and for a missing word in the classic tables.
ARPA_ZERO, LOG_ZERO, LOG_ABSENT = -99.0, -9e30, -9e60


def _forward(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))


def read_arpa(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """SRC-6: ``n, w1, w2, w3, p, bo`` of an ARPA file; n-grams with a word that the vocabulary (word) lacks are dropped.

    A log probability of -99 becomes LOG_ZERO, a missing back-off 0.
    """
    n = F.regexp_extract("line", r"^\\(\d+)-grams:", 1).try_cast("int")
    stop = F.when(F.col("line").startswith("\\end\\") | F.col("line").startswith("\\data\\"), 0)
    rows = lines_below(spark, path, F.coalesce(n, stop)).select("line", F.col("under").alias("n"), n.isNull().alias("body"))
    p = F.split(F.trim("line"), "\\s+")
    rows = rows.where("body and n > 0 and trim(line) <> ''").select("n", p.alias("p")).where("size(p) > n")
    word = lambda k: F.when(F.col("n") >= k, F.get("p", F.lit(k)))
    prob = F.col("p")[0].cast("double")
    rows = rows.select("n", *[word(k).alias(f"w{k}") for k in (1, 2, 3)], F.when(prob <= ARPA_ZERO, LOG_ZERO).otherwise(prob).alias("p"),
                       F.coalesce(F.get("p", F.col("n") + 1).cast("double"), F.lit(0.0)).alias("bo"))
    if vocabulary is not None:
        for k in (1, 2, 3):
            known = vocabulary.select(F.col("word").alias(f"w{k}")).distinct()
            rows = rows.where(F.col(f"w{k}").isNull()).unionByName(rows.join(known, f"w{k}", "left_semi").select(rows.columns))
    return rows


def arpa_lines(ngrams: DataFrame) -> DataFrame:
    """``sec, w1, w2, w3, value`` lines of an ARPA file for (n, w1, w2, w3, p, bo), to be written in this order."""
    body = ngrams.select((F.col("n") * 10 + 1).alias("sec"), "w1", "w2", "w3", F.concat_ws(" ", F.format_string("%.6f", "p"), "w1", "w2", "w3", F.when(F.col("bo") != 0, F.format_string("%.6f", "bo"))).alias("value"))
    none = [F.lit(None).cast("string").alias(c) for c in ("w1", "w2", "w3")]
    heads = ngrams.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    counts = heads.select(F.lit(1).alias("sec"), *none, F.format_string("ngram %d=%d", "n", "k").alias("value"))
    titles = heads.select((F.col("n") * 10).alias("sec"), *none, F.format_string("\n\\%d-grams:", "n").alias("value"))
    spark = ngrams.sparkSession
    ends = spark.createDataFrame([(0, None, None, None, "\\data\\"), (99, None, None, None, "\n\\end\\")], "sec int, w1 string, w2 string, w3 string, value string")
    return body.unionByName(counts).unionByName(titles).unionByName(ends)


def write_arpa(ngrams: DataFrame, path: str) -> None:
    """One text file, as the format asks for."""
    arpa_lines(ngrams).orderBy("sec", "w1", "w2", "w3").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_lexicon(spark: SparkSession, path: str, phones: DataFrame | None = None) -> DataFrame:
    """SRC-7: lines ``word phone phone ...`` as ``word, word_id, variant, phones``; variants of a word share its id.

    An empty pronunciation, or a phone that ``phones`` (name) lacks, ends the job.
    """
    p = F.split(F.trim("line"), "\\s+")
    rows = file_lines(spark, path).where("trim(line) <> ''").select("file", "pos", p[0].alias("word"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("phones"))
    rows = rows.withColumn("phones", F.when(F.size("phones") == 0, F.raise_error(F.concat(F.lit("no pronunciation of "), "word")).cast("array<string>")).otherwise(F.col("phones")))
    if phones is not None:
        known = phones.agg(F.collect_set("name").alias("known"))  # a phone set is a few dozen names
        lost = F.filter("phones", lambda x: ~F.array_contains("known", x))
        rows = rows.crossJoin(F.broadcast(known)).withColumn("phones", F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("unknown phone "), F.get(lost, F.lit(0)))).cast("array<string>")).otherwise(F.col("phones"))).drop("known")
    ids = dense_index(rows.groupBy("word").agg(F.min(F.struct("file", "pos")).alias("at")), [F.col("at")], "word_id").select("word", "word_id")
    variant = F.row_number().over(Window.partitionBy("word").orderBy("file", "pos"))
    return rows.withColumn("variant", variant).join(ids, "word").select("word", "word_id", "variant", "phones")


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: ``phone_id, name, is_sil`` of a list with its two count lines; silences come first, names have at most 9 characters."""
    rows = file_lines(spark, path).where("trim(line) <> ''")
    sils = _forward(F.regexp_extract("line", r"^Number of SIL's:\s*(\d+)", 1).try_cast("int"))
    rows = rows.select("file", "pos", F.trim("line").alias("name"), sils.alias("sils")).where("not name like 'Number of %'")
    number = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return rows.select(number.alias("phone_id"), F.substring("name", 1, 9).alias("name"), (number < F.coalesce("sils", F.lit(0))).alias("is_sil"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: ``utt, l, m, r, b1, e1, b2, e2, b3, e3`` of phone lines ``#Phone# L M R |b|e|b|e|b|e|`` below banner lines ``## label ##``."""
    rows = lines_below(spark, path, F.nullif(F.regexp_extract("line", r"^##\s*(\S+)\s*##", 1), F.lit(""))).select("line", F.col("under").alias("utt")).where("line like '#Phone#%'")
    names = F.split(F.trim(F.regexp_extract("line", r"^#Phone#\s+([^|]*)", 1)), "\\s+")
    times = F.array_remove(F.transform(F.split(F.regexp_extract("line", r"\|(.*)$", 1), "\\|"), lambda x: F.trim(x)), "")
    out = [F.get(times, F.lit(i)).cast("int").alias(c) for i, c in enumerate(("b1", "e1", "b2", "e2", "b3", "e3"))]
    return rows.select("utt", names[0].alias("l"), names[1].alias("m"), names[2].alias("r"), *out)


def alignment_lines(rows: DataFrame) -> DataFrame:
    """SNK-4: the lines of ``read_alignment``, as ``utt, ord, value``."""
    banner = rows.select("utt").distinct().select("utt", F.lit(-1).alias("ord"), F.format_string("## %s ##", "utt").alias("value"))
    line = F.format_string("#Phone# %s %s %s |%d|%d|%d|%d|%d|%d|", "l", "m", "r", "b1", "e1", "b2", "e2", "b3", "e3")
    return banner.unionByName(rows.select("utt", (F.row_number().over(Window.partitionBy("utt").orderBy("b1")) - 1).alias("ord"), line.alias("value")))


def lattice_lines(arcs: DataFrame, ends: DataFrame) -> DataFrame:
    """SNK-5: lines of each lattice as ``utt, sec, a, b, value``: name, nodes, initial, final, then one line for each arc."""
    head = ends.join(arcs.groupBy("utt").agg(F.countDistinct("dst").alias("n")), "utt")
    rows = [head.select("utt", F.lit(k).alias("sec"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), v.alias("value")) for k, v in enumerate((
        F.format_string("name %s", F.col("utt").cast("string")), F.format_string("nodes %d", F.col("n") + 1), F.format_string("initial %d", "first"), F.format_string("final %d", "last"), F.lit("transitions")))]
    body = arcs.select("utt", F.lit(9).alias("sec"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("%d %d %s %.6f %.6f", "src", "dst", "word", "am", "lm").alias("value"))
    out = body
    for r in rows:
        out = out.unionByName(r)
    return out


def read_lattices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-12: arcs (utt, src, dst, word, am, lm) and ends (utt, first, last)."""
    rows = lines_below(spark, path, F.nullif(F.regexp_extract("line", r"^name (.*)$", 1), F.lit(""))).select("line", F.col("under").alias("utt"))
    p = F.split("line", " ")
    arcs = rows.where(F.col("line").rlike(r"^\d+ \d+ ")).select("utt", p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), p[2].alias("word"), p[3].cast("double").alias("am"), p[4].cast("double").alias("lm"))
    number = lambda k: F.max(F.nullif(F.regexp_extract("line", rf"^{k} (\d+)$", 1), F.lit("")).cast("long"))
    return arcs, rows.groupBy("utt").agg(number("initial").alias("first"), number("final").alias("last")).where("utt is not null")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: ``spk gender audio_label channel audio segments`` lines."""
    names = ("spk", "gender", "audio_label", "channel", "audio", "segments")
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where(F.size(p) >= 6).select(*[p[i].alias(n) for i, n in enumerate(names)])


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: ``audio meta hyp`` lines; missing columns are null."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("audio", "meta", "hyp"))])


def hypothesis_lines(words: DataFrame, xml: bool = False) -> DataFrame:
    """SNK-3: one line for each recognised word (utt, ord, word, first, last, am, lm), as text or XML."""
    total = F.col("am") + F.col("lm")
    safe = F.translate("word", "<>", "[]")
    plain = F.format_string("%s %.2f %.2f %.4f %.4f %.4f", safe, F.col("first") / 100.0, (F.col("last") + 1) / 100.0, "am", "lm", total)
    tagged = F.format_string('<word id="%s" begin="%.2f" end="%.2f" am="%.4f" lm="%.4f" score="%.4f"/>', F.regexp_replace(F.regexp_replace(safe, "&", "&amp;"), '"', "&quot;"), F.col("first") / 100.0, (F.col("last") + 1) / 100.0, "am", "lm", total)
    return words.select("utt", "ord", (tagged if xml else plain).alias("value"))
