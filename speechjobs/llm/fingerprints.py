"""Document fingerprints: homomorphic multiset hashes, in DataFrame and SQL expressions only.

Each paragraph hashes to a wide vector of 16-bit numbers; a document's vector is the sum over its paragraphs, each lane
modulo a power of two. Sums do not depend on the order, and paragraphs can be added or taken away later. The difference of
two vectors is the sum over the paragraphs that only one document has, so with numbers taken from their mean the angle
between two vectors tells how much of their paragraphs is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Paragraphs end at line breaks; a line of several sentences counts as several.
PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"
#: Longs in a vector; each holds two lanes, at bits 0 and 32.
WIDTH = 48
#: A lane is a sum modulo this; what a paragraph adds is below LEVELS, so 16,384 paragraphs pass before a lane wraps.
MODULUS, LEVELS = 1 << 30, 1 << 16
#: The same for both lanes of a long. The free bits above a lane take its carry, which is masked off.
SUM_MASK, PART_MASK = (MODULUS - 1) * ((1 << 32) + 1), (LEVELS - 1) * ((1 << 32) + 1)
#: Ranges of ids that a table is cut into at most, and ids looked at for each bound; a larger table has larger ranges.
MOST_RANGES, SAMPLED = 4096, 64


def multiset_vector(text: Column, separator: str = PARAGRAPH_END) -> Column:
    """The multiset hash of a text: array of WIDTH longs with two lanes each. Null and empty texts give zeros."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: p != "")
    # the seed goes first: every long comes from a hash of its own of the whole paragraph
    hashed = F.transform(pieces, lambda p: F.array(*[F.xxhash64(F.lit(i), p) for i in range(WIDTH)]))
    return F.aggregate(hashed, F.array_repeat(F.lit(0).cast("long"), WIDTH), lambda total, h: F.zip_with(total, h, lambda a, x: (a + x.bitwiseAND(F.lit(PART_MASK))).bitwiseAND(F.lit(SUM_MASK))))


def insert(vector: Column, other: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return F.zip_with(vector, other, lambda a, b: (a + b).bitwiseAND(F.lit(SUM_MASK)))


def delete(vector: Column, other: Column) -> Column:
    """Vector after the paragraphs of ``other``, which ``vector`` must hold, are taken away."""
    borrow = MODULUS * ((1 << 32) + 1)
    return F.zip_with(vector, other, lambda a, b: (a + F.lit(borrow) - b).bitwiseAND(F.lit(SUM_MASK)))


def paragraphs(text: Column, separator: str = PARAGRAPH_END) -> Column:
    """Number of paragraphs that the vector sums."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda p: p != "")).cast("long")


def lanes(vector: Column) -> Column:
    """The lane values one by one."""
    return F.flatten(F.transform(vector, lambda x: F.array(x.bitwiseAND(F.lit(MODULUS - 1)), F.shiftrightunsigned(x, 32))))


def fingerprint(vector: Column, count: Column) -> Column:
    """Hex print of the count and of all lanes. Texts of the same paragraphs in any order print the same."""
    return F.lower(F.concat(F.lpad(F.hex(count), 8, "0"), F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def likeness(one: Column, n_one: Column, two: Column, n_two: Column) -> Column:
    """0..1: the cosine of two vectors with lanes taken from the mean of what their paragraphs add; 1 for equal vectors, so
    for two empty texts too."""

    def centred(vector: Column, n: Column) -> Column:
        return F.transform(lanes(vector), lambda x: x.cast("double") - n * F.lit((LEVELS - 1) / 2))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    a, b = centred(one, n_one), centred(two, n_two)
    cosine = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
    return F.when((one == two) & (n_one == n_two), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def id_ranges(rows: DataFrame, task_bytes: int) -> DataFrame:
    """``rows`` (id, text, tie) with ``range``, a number that rises as ids fall.

    Ranges hold about ``task_bytes`` of text, or more where that would make more than MOST_RANGES of them. Bounds are ids of
    a bounded sample, in one row that is broadcast; they only deal the work out, no result depends on them. Rows without an
    id come last, in ranges of their tie.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    n, missing, total = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, min(MOST_RANGES, -(-total // task_bytes)))
    of_none = min(parts, -(-parts * missing // n)) if missing else 0
    wanted = parts * SAMPLED
    ids = rows.select("id").filter("id is not null")
    seen = sorted({r[0] for r in (ids.sample(min(1.0, 1.2 * wanted / n), 7) if n > wanted else ids).limit(2 * wanted).collect()}, reverse=True)
    step = max(1, len(seen) // max(1, parts - of_none))
    bounds = seen[step - 1 : -1 : step]  # a range ends with its bound
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    schema = StructType([StructField("__groups", ArrayType(ArrayType(kind)))])
    known = spark.createDataFrame([(groups,)], schema)
    above = lambda xs: F.size(F.filter(xs, lambda x: x > F.col("id")))
    group = above(F.transform("__groups", lambda g: F.element_at(g, -1)))
    inner = F.coalesce(above(F.get("__groups", group)), F.lit(0))
    by_tie = F.floor((F.col("tie") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(of_none)).cast("int")
    number = F.when(F.col("id").isNull(), len(bounds) + 1 + F.least(by_tie, F.lit(max(0, of_none - 1)))).otherwise(group * width + inner)
    return rows.crossJoin(F.broadcast(known)).withColumn("range", number.cast("int")).drop("__groups")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprint every text, the same text with its last third overwritten by the start of the next document, and
    compare both, and the text with the next document.

    The next document is found within ranges of ids, in falling order; the first row of each range also goes to the range
    before, so no window spans the table, and a window only reads on, whatever the size of its range. After the last
    document comes the first.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``n_paragraphs``.

    Defined cases: null text is empty; ids are of any type that sorts; rows that repeat an id are ordered by a hash of the
    text; rows without an id come last, in the order of that hash; a table of one row has itself as the next; an empty
    table gives an empty table; further columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    placed = id_ranges(base, task_bytes)
    # The first row of each range, one for each of at most 2 * MOST_RANGES ranges. The range before, which need not have rows,
    # is the next lower number that has.
    top = F.struct((~F.col("id").isNull()).alias("has"), "id", (-F.col("tie").cast("decimal(20,0)")).alias("tie"))
    firsts = placed.select("range", "id", "tie").groupBy("range").agg(F.max(top).alias("top"))
    turn = Window.orderBy("range")
    last = F.max("range").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("range").alias("__range"), F.col("top.id").alias("__id"), (-F.col("top.tie")).cast("long").alias("__tie"), F.coalesce(F.lag("range").over(turn), last).alias("__before"))
    same = (F.col("range") == F.col("__range")) & F.col("id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))
    heads = placed.join(F.broadcast(firsts), same).groupBy("__before").agg(*[F.first(c).alias(c) for c in ("id", "text", "tie")])
    both = placed.select("id", "text", "tie", "range", F.lit(0).alias("ghost")).unionByName(heads.select("id", "text", "tie", F.col("__before").alias("range"), F.lit(1).alias("ghost")))
    # each text's vector once, before the texts are shuffled
    both = both.withColumns({"vector": multiset_vector(F.col("text")), "n": paragraphs(F.col("text"))})
    falling = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "tie")
    following = both.select("*", *[F.lead(c).over(falling).alias(f"next_{c}") for c in ("text", "vector", "n")]).filter("ghost = 0")
    chars = F.char_length("text")
    third = F.floor(chars / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), chars - third)
    edited = following.withColumns({"n_chars": chars.cast("long"), "edited": F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third))})
    edited = edited.withColumns({"edited_vector": multiset_vector(F.col("edited")), "edited_n": paragraphs(F.col("edited"))})
    return edited.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("vector"), F.col("n")).alias("fingerprint"),
        fingerprint(F.col("edited_vector"), F.col("edited_n")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("n"), F.col("edited_vector"), F.col("edited_n")).alias("near_edited"),
        likeness(F.col("vector"), F.col("n"), F.col("next_vector"), F.col("next_n")).alias("near_next"), F.col("n").alias("n_paragraphs"),
    )
