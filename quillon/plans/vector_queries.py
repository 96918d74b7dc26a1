"""Queries of vector and string expressions, one for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..sources.numbering import dense_index
from . import views as v
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _pairs(spark, d):
    f = v.frames(spark, d)
    return f.select("t", F.col("vec").alias("a")).join(f.select((F.col("t") - 1).alias("t"), F.col("vec").alias("b")), "t")


PAIR = {"p": "SELECT a.t, a.d, a.x, b.x AS y FROM dims a JOIN dims b ON b.t = a.t + 1 AND b.d = a.d"}
R = "round({}, 6) + 0.0"

#: Element-wise operators: the Spark vector of (a, b), and SQL over x and y.
ELEMENTS = {
    "vec1_add": (vec.add, "x + y"),
    "vec2_subtract": (vec.subtract, "x - y"),
    "vec3_multiply": (vec.multiply, "x * y"),
    "vec4_divide": (lambda a, b: vec.divide(a, vec.shift(vec.square(b), 1.0)), "x / (y * y + 1)"),
    "vec5_scale": (lambda a, b: vec.scale(a, 2.5), "x * 2.5"),
    "vec6_add_scalar": (lambda a, b: vec.shift(a, -0.75), "x - 0.75"),
    "vec7_sqrt": (lambda a, b: vec.sqrt(vec.square(a)), "sqrt(x * x)"),
    "vec8_square": (lambda a, b: vec.square(a), "x * x"),
    "vec12_floor_elements": (lambda a, b: vec.floor_at(a, -0.1)["vec"], "greatest(x, -0.1)"),
    "vec14_one_hot_max": (lambda a, b: vec.one_hot_max(a), "CASE WHEN d = (first_value(d) OVER (PARTITION BY t ORDER BY x DESC, d)) THEN x ELSE 0 END"),
    "vec15_compare_to_mask": (lambda a, b: F.transform(vec.count_smaller(a, b, F.transform(a, lambda x: F.lit(3))), lambda c: c.cast("double")), "3::DOUBLE + CASE WHEN x < y THEN 1 ELSE 0 END"),
}
for _name, (_fn, _sql) in ELEMENTS.items():
    REGISTRY.add(_name, lambda s, d, fn=_fn: _pairs(s, d).select("t", F.posexplode(fn(F.col("a"), F.col("b"))).alias("d", "y")).select(
        "t", F.col("d").cast("long"), F.round("y", 6).alias("y")), v.with_views(f"SELECT t, d, {R.format(_sql)} AS y FROM p", "dims", **PAIR))

#: Operators that give one value for each frame.
REDUCED = {
    "vec9_dot": (vec.dot, "round(sum(x * y), 6) + 0.0"),
    "vec10_squared_distance": (vec.squared_distance, "round(sum((x - y) * (x - y)), 6) + 0.0"),
    "vec11_product": (lambda a, b: vec.product(vec.shift(vec.scale(a, 0.1), 1.0)), "round(exp(sum(ln(x * 0.1 + 1))), 6) + 0.0"),
    "vec12_any_floored": (lambda a, b: vec.floor_at(a, -0.1)["floored"].cast("double"), "max(CASE WHEN x < -0.1 THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "vec13_negative_check": (lambda a, b: vec.any_negative(a).cast("double"), "max(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "vec16_slice": (lambda a, b: vec.total(vec.part(a, 10, 20)), "round(sum(CASE WHEN d BETWEEN 10 AND 29 THEN x ELSE 0 END), 6) + 0.0"),
    "vec17_concat": (lambda a, b: vec.total(F.concat(vec.part(a, 0, 5), b, vec.part(a, 60, 4))), "round(sum(CASE WHEN d < 5 OR d BETWEEN 60 AND 63 THEN x ELSE 0 END) + sum(y), 6) + 0.0"),
    "vec18_mahalanobis": (lambda a, b: vec.mahalanobis(a, b, vec.shift(vec.square(b), 0.5)), "round(-0.5 * sum((x - y) * (x - y) / (y * y + 0.5)), 6) + 0.0"),
    "vec19_fill_get_set": (lambda a, b: vec.get(vec.put(vec.add(a, vec.filled(64, 2.0)), 3, F.lit(9.0)), 3) + vec.get(a, 4), "round(9.0 + sum(CASE WHEN d = 4 THEN x ELSE 0 END), 6) + 0.0"),
    "vec20_adapt_copy": (lambda a, b: vec.total(vec.add(vec.scale(a, 0.9), vec.scale(b, 0.1))), "round(sum(x * 0.9 + y * 0.1), 6) + 0.0"),
    "vec21_weighted_streams": (lambda a, b: vec.total(vec.weighted_streams([(vec.scale(vec.part(a, 0, 32), 0.7), 0.7), (vec.scale(vec.part(a, 32, 32), 0.3), 0.3)])), "round(sum(CASE WHEN d < 32 THEN x * 0.7 ELSE x * 0.3 END), 6) + 0.0"),
    "math2_clamped_log": (lambda a, b: vec.clamp_log(vec.scale(a, 4000.0)[0]), "round(greatest(sum(CASE WHEN d = 0 THEN x * 4000.0 ELSE 0 END), -1000.0), 6) + 0.0"),
    "math1_log": (lambda a, b: vec.safe_log(vec.dot(a, a)), "round(ln(greatest(sum(x * x), 5e-43)), 6) + 0.0"),
}
for _name, (_fn, _sql) in REDUCED.items():
    REGISTRY.add(_name, lambda s, d, fn=_fn: _pairs(s, d).select("t", F.round(fn(F.col("a"), F.col("b")), 6).alias("y")),
                 v.with_views(f"SELECT t, {_sql} AS y FROM p GROUP BY t", "dims", **PAIR))


@query("str1_split_first", "SELECT doc_id, string_split_regex(l, '[ \\t]+')[1] AS head, len(l) - len(string_split_regex(l, '[ \\t]+')[1]) AS rest_chars FROM (SELECT doc_id, regexp_extract(rtrim(text), '^[^\\n]*') AS l FROM documents)".replace("\\\\", "\\"))
def _(spark, d):
    line = v.table(spark, d, "documents").select("doc_id", F.regexp_extract(F.rtrim("text"), "^[^\\n]*", 0).alias("l"))
    head, _ = tx.head_and_rest(F.col("l"))
    return line.select("doc_id", head.alias("head"), (F.length("l") - F.length(head)).cast("long").alias("rest_chars"))


@query("str2_right_trim", "SELECT page_id, regexp_replace(url || ' \t ', '[ \t\r\n]+$', '') AS url FROM pages")
def _(spark, d):
    return v.table(spark, d, "pages").select("page_id", tx.right_trim(F.concat("url", F.lit(" \t "))).alias("url"))


@query("str3_utterance_label", "SELECT conv_id, turn, role || '-' || conv_id AS label FROM conversations")
def _(spark, d):
    c = v.table(spark, d, "conversations").withColumn("line", F.concat(F.lit("some words ("), "role", F.lit("-"), "conv_id", F.lit(")")))
    return c.select("conv_id", "turn", tx.utterance_label(F.col("line")).alias("label"))


VOCAB = {"vocab": "SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT word FROM words GROUP BY word HAVING count(*) >= 5)"}


def vocabulary(spark, d):
    """Words that occur at least 5 times, numbered from 0 in their order."""
    w = v.words(spark, d).groupBy("word").count().where("count >= 5")
    return dense_index(w.select("word"), [F.col("word")], "word_id")


@query("str4_encode_words", v.with_views("SELECT doc_id, sum(coalesce(word_id, -1))::BIGINT AS id_sum, count(*) FILTER (word_id IS NULL) AS unknown FROM words LEFT JOIN vocab USING (word) GROUP BY doc_id", "words", **VOCAB))
def _(spark, d):
    return tx.encode(v.words(spark, d), vocabulary(spark, d)).groupBy("doc_id").agg(
        F.sum("word_id").alias("id_sum"), F.sum(F.when(F.col("word_id") < 0, 1).otherwise(0)).alias("unknown"))


@query("str5_basename", "SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') AS name FROM pages".replace("\\\\", "\\"))
def _(spark, d):
    return v.table(spark, d, "pages").select("page_id", tx.basename(F.col("url")).alias("name"))


@query("str6_xml_safe", "SELECT page_id, md5(translate(html, '<>', '[]')) AS digest FROM pages")
def _(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.md5(tx.xml_safe(F.col("html")).cast("binary")).alias("digest"))


@query("str7_decode_words", v.with_views("SELECT word_id, word, count(*) AS n FROM words JOIN vocab USING (word) GROUP BY 1, 2", "words", **VOCAB))
def _(spark, d):
    vocab = vocabulary(spark, d)
    ids = tx.encode(v.words(spark, d), vocab, keep_unknown=False).groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))
    return tx.decode(ids, vocab)


@query("join6_vocabulary_encode", v.with_views("SELECT word_id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) JOIN vocab USING (word) GROUP BY 1", "words", **VOCAB))
def _(spark, d):
    """The conversations' words in the documents' vocabulary; words that it lacks go."""
    said = v.table(spark, d, "conversations").select(F.explode(F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")).alias("word"))
    return tx.encode(said, vocabulary(spark, d), keep_unknown=False).groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))


@query("math3_true_modulo", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ((l_linenumber - l_orderkey) % 7 + 7) % 7 AS m FROM lineitem")
def _(spark, d):
    li = v.table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"), tx.true_modulo(F.col("l_linenumber") - F.col("l_orderkey"), 7).alias("m"))
