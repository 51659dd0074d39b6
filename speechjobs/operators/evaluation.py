"""Evaluation of transcriptions over annotated corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechjobs.functions.align import RULES, align_ops, counted_pairs, once_per_pair, with_alignment, word_owner
from speechjobs.functions.gates import allowed_sounds, heard_no_speech
from speechjobs.functions.symbols import edits, strip_all

THRESHOLDS = (30, 40, 50, 60, 70, 80)


def read_utterances(spark: SparkSession, path: str, columns: tuple[str, ...] = ("text", "accuracy", "words")) -> DataFrame:
    """Annotated utterances; only the named columns are read, never the audio."""
    return spark.read.parquet(path).select(*columns)


def flatten_words(utterances: DataFrame) -> DataFrame:
    """``canonical`` and ``phone_scores`` of all words; scores are 0 where the lengths disagree; ``human`` is 0 to 1."""
    phones = F.flatten(F.transform("words", lambda w: w["phones"]))
    scores = F.flatten(F.transform("words", lambda w: w["phones-accuracy"]))
    fitting = F.when(F.size(phones) == F.size(scores), scores).otherwise(F.array_repeat(F.lit(0.0), F.size(phones)))
    return utterances.withColumns({"canonical": phones, "phone_scores": fitting, "human": F.col("accuracy") / 10})


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.json(path, ignoreNullFields=False)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "utt_id string, speaker string, accent string, text string, human_accuracy double, human_total double, canonical array<string>, phone_scores array<double>, predicted array<string>, confidence double, margin double, seconds double"
    return spark.read.schema(schema).json(path)


def with_annotations(predictions: DataFrame, utterances: DataFrame, key: str = "utt_id") -> DataFrame:
    """Predictions joined to their annotations; fails if one side has a row or a text that the other has not."""
    u = utterances.withColumnRenamed("text", "__text").withColumn("__known", F.lit(True))
    joined = predictions.withColumn("__made", F.lit(True)).join(u, key, "full")
    wrong = F.col("__known").isNull() | F.col("__made").isNull() | ~F.col("text").eqNullSafe(F.col("__text"))
    checked = joined.withColumn("__ok", F.when(wrong, F.raise_error(F.concat(F.lit("predictions and annotations disagree at "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return checked.filter("__ok").drop("__ok", "__known", "__made", "__text")


def error_rates(df: DataFrame, keys: tuple[str, ...], reference: str = "canonical", heard: str = "predicted") -> DataFrame:
    """(keys, utterances, phones, errors, per, per_with_stress): edit distance over phones, built in."""
    phones = F.size(reference)
    sums = df.groupBy(*keys).agg(F.count("*").alias("utterances"), F.sum(phones).alias("phones"), F.sum(edits(F.col(reference), F.col(heard))).alias("errors"), F.sum(edits(F.col(reference), F.col(heard), True)).alias("__s"))
    return sums.select(*keys, "utterances", "phones", "errors", F.try_divide("errors", "phones").alias("per"), F.try_divide("__s", "phones").alias("per_with_stress"))


def dictionary_rates(df: DataFrame, dictionaries: dict[str, str], heard: str = "predicted") -> DataFrame:
    """Error rate by accent against each dictionary's target (accent: column), over utterances that all of them know."""
    known = df.filter(" and ".join(f"{c} is not null" for c in dictionaries.values()))
    sums = [F.try_divide(F.sum(edits(F.col(c), F.col(heard))), F.sum(F.size(c))).alias(name) for name, c in dictionaries.items()]
    return known.groupBy("accent").agg(F.count("*").alias("utterances"), *sums)


def word_error_rates(df: DataFrame, keys: tuple[str, ...], reference: str, heard: str) -> DataFrame:
    """Word error rate and the score (1 - wer) * 10, 0 at least. Words become characters of one string by their place in
    the pair's own word list, so distances count words."""
    words = F.array_distinct(F.concat(reference, heard))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, w) + 19968), 4, "0")), "UTF-16BE")), "")
    sums = df.groupBy(*keys).agg(F.sum(F.levenshtein(coded(F.col(reference)), coded(F.col(heard)))).alias("errors"), F.sum(F.size(reference)).alias("words"))
    wer = F.try_divide("errors", "words")
    return sums.withColumns({"wer": wer, "score": F.greatest(F.lit(0.0), (1 - wer) * 10)})


def operations(df: DataFrame, reference: str = "canonical", heard: str = "predicted", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each alignment operation: keep, op (order), kind, ref_index, expected, heard."""
    aligned = with_alignment(df, reference, heard, "__a")
    rows = aligned.select(*keep, strip_all(F.col(reference)).alias("r"), strip_all(F.col(heard)).alias("h"), F.posexplode("__a.ops").alias("op", "o"))
    return rows.select(*keep, "op", "o.kind", "o.ref_index", F.get("r", F.col("o.ref_index")).alias("expected"), F.get("h", F.col("o.hyp_index")).alias("heard"))


def operation_counts(df: DataFrame, keys: tuple[str, ...] = (), reference: str = "canonical", heard: str = "predicted") -> DataFrame:
    """(keys, kind, expected, heard, n): operations by what they do to which sounds. Pairs are counted first, then each
    is aligned and taken apart once."""
    pairs = counted_pairs(df, keys, reference, heard)
    rows = pairs.select(*keys, "n", strip_all(F.col("ref")).alias("r"), strip_all(F.col("hyp")).alias("h"), F.explode("alignment.ops").alias("o"))
    sounds = rows.select(*keys, "n", "o.kind", F.get("r", F.col("o.ref_index")).alias("expected"), F.get("h", F.col("o.hyp_index")).alias("heard"))
    return sounds.groupBy(*keys, "kind", "expected", "heard").agg(F.sum("n").alias("n"))


def _weight(ops: DataFrame) -> Column:
    """Rows stand for themselves, or for ``n`` of their kind."""
    return F.col("n") if "n" in ops.columns else F.lit(1)


def confusions(ops: DataFrame, most: int = 15) -> DataFrame:
    """The most frequent substitutions of operations() or operation_counts(); ties by the two sounds."""
    return ops.filter("kind = 'substitute'").groupBy("expected", "heard").agg(F.sum(_weight(ops)).alias("n")).orderBy(F.desc("n"), "expected", "heard").limit(most)


def sound_rates(ops: DataFrame) -> DataFrame:
    """Count and error rate of each target sound in operations() or operation_counts(), the worst first."""
    n, wrong = F.sum(_weight(ops)), F.sum(F.when(F.col("kind") != "equal", _weight(ops)).otherwise(0))
    return ops.filter("kind <> 'insert'").groupBy("expected").agg(n.alias("n"), (wrong / n).alias("error_rate")).orderBy(F.desc("error_rate"), "expected")


def detection(flags: DataFrame, flagged: str = "flagged", wrong: str = "wrong") -> DataFrame:
    """Precision, recall, F1 and false-alarm rate of boolean columns; 0 where the denominator is 0."""
    f, w = F.col(flagged), F.col(wrong)
    c = flags.agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & w).alias("fn"), F.count_if(~f & ~w).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "false_alarm_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    return out.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "positives": F.col("tp") + F.col("fn"), "negatives": F.col("fp") + F.col("tn")})


def sound_flags(df: DataFrame, reference: str = "canonical", heard: str = "predicted", scores: str = "phone_scores", below: float = 1.5) -> DataFrame:
    """(flagged, wrong) of each target sound: not heard as written, and rated under ``below`` by a human."""
    ops = operations(df.withColumn("__s", F.col(scores)), reference, heard, ("__s",)).filter("kind <> 'insert'")
    return ops.select((F.col("kind") != "equal").alias("flagged"), (F.get("__s", F.col("ref_index")) < below).alias("wrong"))


def agreement(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation from moments (NaN where a variance is 0) and mean absolute error."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.groupBy(*keys).agg(F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.avg(F.abs(a - b)).alias("mae"), F.count("*").alias("n"))
    return m.select(*keys, "n", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(float("nan")).alias("pearson"), "mae")


def corpus_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    speakers = F.approx_count_distinct("speaker") if approximate else F.countDistinct("speaker")
    return df.agg(F.count("*").alias("utterances"), speakers.alias("speakers"), F.sum(F.size("canonical")).alias("phones"), (F.sum("seconds") / 60).alias("minutes"))


def match_measures(pairs: DataFrame, target: str = "target", heard: str = "heard", rules: dict | None = None) -> DataFrame:
    """``pairs`` with one column for each rule, percent of target sounds attempted, worked out once for each distinct pair."""
    made = rules or RULES

    def measured(distinct: DataFrame) -> DataFrame:
        aligned = distinct.withColumn("__a", align_ops(strip_all(F.col("ref")), strip_all(F.col("hyp"))))
        return aligned.withColumn("__m", F.struct(*[rule(F.col("__a.ops"), F.col("ref"), F.col("hyp")).alias(name) for name, rule in made.items()]))

    return once_per_pair(pairs, target, heard, measured, "__m").select(*pairs.columns, *[F.col("__m").getField(name).alias(name) for name in made])


def counted_measures(pairs: DataFrame, keys: tuple[str, ...], target: str = "target", heard: str = "heard", rules: dict | None = None) -> DataFrame:
    """(keys, target, heard, n, one column for each rule): the same of counted pairs, for rates by ``keys``."""
    counted = counted_pairs(pairs, keys, target, heard)
    made = {name: rule(F.col("alignment.ops"), F.col("ref"), F.col("hyp")) for name, rule in (rules or RULES).items()}
    return counted.select(*keys, F.col("ref").alias(target), F.col("hyp").alias(heard), "n", *[m.alias(name) for name, m in made.items()])


def pass_rates(measured: DataFrame, keys: tuple[str, ...], rules: tuple[str, ...] = tuple(RULES), thresholds=THRESHOLDS) -> DataFrame:
    """(keys, rule, threshold, n, kept): share of the pairs of match_measures() or counted_measures() at or above each
    threshold, all in one pass."""
    weight = _weight(measured)
    kept = lambda r, t: F.sum(F.when(F.col(r) >= t, weight).otherwise(0)) / F.sum(weight)
    sums = measured.groupBy(*keys).agg(F.sum(weight).alias("__n"), *[kept(r, t).alias(f"{r}|{t}") for r in rules for t in thresholds])
    columns = [f"{r}|{t}" for r in rules for t in thresholds]
    long = sums.unpivot([*keys, "__n"], columns, "name", "kept")
    return long.select(*keys, F.split("name", r"\|")[0].alias("rule"), F.split("name", r"\|")[1].cast("int").alias("threshold"), F.col("__n").alias("n"), "kept")


def choose_rule(rates: DataFrame, group: str, wrong: str, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """The rule and threshold that separate genuine groups from the wrong one best; the first in order wins ties."""
    sep = rates.groupBy("rule", "threshold").agg((F.avg(F.when(F.col(group) != wrong, F.col("kept"))) - F.max(F.when(F.col(group) == wrong, F.col("kept")))).alias("separation"))
    place = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("rule"))
    return sep.agg(F.max_by(F.struct("rule", "threshold", "separation"), F.struct(F.round("separation", 9).alias("s"), (-place).alias("p"), (-F.col("threshold")).alias("t"))).alias("b")).select("b.*")


def kept_by_length(measured: DataFrame, group: str, rule: str, threshold: int, target: str = "target", lengths=(3, 4, 5)) -> DataFrame:
    weight = _weight(measured)
    kept = F.sum(F.when(F.col(rule) >= threshold, weight).otherwise(0)) / F.sum(weight)
    return measured.filter(F.size(target).isin(*lengths)).groupBy(group, F.size(target).alias("length")).agg(F.sum(weight).alias("n"), kept.alias("kept"))


def wrong_targets(pairs: DataFrame, slack: float = 0.25, id_col: str = "id", target: str = "target", heard: str = "heard") -> DataFrame:
    """(id, target, heard): each transcription with a target of another word, of a length within ``slack`` of its own.

    Distinct targets are numbered by length and spelling. A row looks at those of fitting lengths as a ring and goes from its
    own place to another one, by arithmetic on its id, so the pairing is two equality joins, reruns agree, and no row meets
    its own target. Lengths are few; the list of their counts is one small array. Every row stays: where no other target
    fits, the target is null.
    """
    own = F.array_join(strip_all(F.col(target)), " ")
    words = pairs.select(own.alias("word"), F.size(target).alias("length")).distinct()
    numbered = words.withColumn("nth", F.row_number().over(Window.partitionBy("length").orderBy("word")) - 1)
    counts = words.groupBy("length").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("counts"))
    sums = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    places = numbered.crossJoin(counts).withColumn("fit", F.filter("counts", lambda c: F.abs(c["length"] - F.col("length")) <= F.lit(slack) * F.col("length")))
    places = places.select("word", "length", "fit", sums(F.col("fit")).alias("total"), (sums(F.filter("fit", lambda c: c["length"] < F.col("length"))) + F.col("nth")).alias("place"))
    rows = pairs.select(F.col(id_col).alias("id"), F.col(heard).alias("heard"), own.alias("word"), F.size(target).alias("length")).join(places, ["word", "length"])
    at = (F.col("place") + 1 + F.pmod(F.col("id") * 31, F.col("total") - 1)) % F.col("total")

    def step(s: Column, c: Column) -> Column:
        """Go through the lengths until the place falls into one."""
        here = F.struct(c["length"].alias("length"), s["left"].alias("nth"), F.lit(-1).cast("long").alias("left"))
        on = F.struct(s["length"].alias("length"), s["nth"].alias("nth"), (s["left"] - c["n"]).alias("left"))
        return F.when(s["left"] < 0, s).when(s["left"] < c["n"], here).otherwise(on)

    begin = F.struct(F.lit(-1).alias("length"), F.lit(-1).cast("long").alias("nth"), at.alias("left"))
    picked = rows.withColumn("pick", F.when(F.col("total") > 1, F.aggregate("fit", begin, step)))
    other = numbered.select(F.col("word").alias("other"), F.col("length").alias("__length"), F.col("nth").alias("__nth"))
    found = picked.join(other, (F.col("pick.length") == F.col("__length")) & (F.col("pick.nth") == F.col("__nth")), "left")
    return found.select(F.col("id").alias(id_col), F.split("other", " ").alias("target"), "heard")


def compare_runs(one: DataFrame, two: DataFrame, key: str = "utt_id") -> DataFrame:
    """Two transcription runs of the same utterances: error rates, changed transcripts, mean gaps of score and features."""
    a, b = one.alias("a"), two.alias("b")
    joined = a.join(b, key)
    rate = lambda side: F.try_divide(F.sum(edits(F.col("a.reference"), F.col(f"{side}.heard"))), F.sum(F.size("a.reference")))
    gap = F.avg(F.aggregate(F.zip_with("a.features", "b.features", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a.features"))
    return joined.agg(F.count("*").alias("utterances"), rate("a").alias("per_one"), rate("b").alias("per_two"), F.count_if(F.col("a.heard") != F.col("b.heard")).alias("changed"), (F.avg(F.abs(F.col("a.score") - F.col("b.score"))) * 10).alias("score_gap"), gap.alias("feature_gap"))


def condition_table(runs: DataFrame, clean: tuple[str, str]) -> DataFrame:
    """Error rate and mean distance from the clean run's score by (condition, variant)."""
    base = runs.filter((F.col("condition") == clean[0]) & (F.col("variant") == clean[1])).select("utt_id", F.col("score").alias("clean_score"))
    return runs.join(base, "utt_id").groupBy("condition", "variant").agg(F.count("*").alias("n"), F.try_divide(F.sum(edits(F.col("reference"), F.col("heard"))), F.sum(F.size("reference"))).alias("per"), F.avg(F.abs(F.col("score") - F.col("clean_score"))).alias("score_gap"))


def spread(df: DataFrame, value: str, cutoffs: tuple[float, ...], keys: tuple[str, ...] = (), approximate: bool = False) -> DataFrame:
    """n, minimum, percentiles 1, 5, 50 (interpolated) and the share below each cutoff."""
    shares = [0.01, 0.05, 0.5]
    p = F.percentile_approx(value, shares, 10_000) if approximate else F.percentile(value, F.array(*map(F.lit, shares)))
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), p.alias("p"), *[F.avg((F.col(value) < c).cast("int")).alias(f"below_{c:g}") for c in cutoffs])
    return sums.select(*keys, "n", "least", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p5"), F.col("p")[2].alias("median"), *[f"`below_{c:g}`" for c in cutoffs])


def rate_summary(takes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Speaking rates of takes (sounds, speech_seconds): spread over takes with speech, takes without, share silent."""
    rate = F.when(F.col("speech_seconds") > 0, F.col("sounds") / F.col("speech_seconds"))
    p = F.percentile(rate, F.array(F.lit(0.01), F.lit(0.5)))
    sums = takes.groupBy(*keys).agg(F.count("*").alias("takes"), F.count_if(~(F.col("speech_seconds") > 0)).alias("without_speech"), F.avg(heard_no_speech(F.col("sounds"), F.col("speech_seconds")).cast("int")).alias("silent"), p.alias("p"))
    return sums.select(*keys, "takes", "without_speech", "silent", F.col("p")[0].alias("rate_p1"), F.col("p")[1].alias("rate_median"))


def length_drops(pairs: DataFrame, keys: tuple[str, ...] = (), natural: Column | None = None) -> DataFrame:
    """Shares of takes with too few and with extra sounds for their target (fewest, most, heard)."""
    allowed = allowed_sounds(F.col("fewest"), F.col("most"), F.lit(False) if natural is None else natural)
    few, extra = F.col("heard") < allowed["fewest"], F.col("heard") > allowed["most"]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(few.cast("int")).alias("too_few"), F.avg(extra.cast("int")).alias("extra"), F.avg((few | extra).cast("int")).alias("dropped"))


def condition_summary(rows: DataFrame, key: str = "condition") -> DataFrame:
    """Single words by condition: rate, silence, length, confidence, noise and match. rows: sounds, speech_seconds,
    fewest, most, confidence, snr_db, matched."""
    lengths = length_drops(rows.withColumn("heard", F.col("sounds")), (key,)).drop("n")
    other = rows.groupBy(key).agg(F.avg((F.col("confidence") < 0.5).cast("int")).alias("unsure"), F.avg((F.col("snr_db") < 20).cast("int")).alias("noisy"), F.avg((F.col("matched") < 30).cast("int")).alias("unmatched"))
    return rate_summary(rows, (key,)).join(lengths, key).join(other, key)


def low_rated(utterances: DataFrame, at_most: float = 5.0) -> DataFrame:
    return utterances.filter(F.col("accuracy") <= at_most)


def low_rated_words(utterances: DataFrame, at_most: float = 5.0, lengths=(3, 4, 5)) -> DataFrame:
    """(utt_id, nth, target): words of 3 to 5 sounds with a word score up to ``at_most``."""
    words = utterances.select("utt_id", F.posexplode("words").alias("nth", "w"))
    return words.filter((F.col("w.accuracy") <= at_most) & F.size("w.phones").isin(*lengths)).select("utt_id", "nth", F.col("w.phones").alias("target"))


def cut_words(utterances: DataFrame, heard: str = "predicted") -> DataFrame:
    """(utt_id, nth, target, heard): the heard sounds of each word. ``words``: array of arrays of target sounds.

    A heard sound belongs to the word of the latest aligned target sound; sounds before any belong to the first word.
    """
    base = utterances.select("utt_id", "words", F.col(heard).alias("heard"))
    ops = base.select("utt_id", "words", "heard", F.posexplode(align_ops(strip_all(F.flatten("words")), strip_all(F.col("heard")))["ops"]).alias("op", "o"))
    owner = F.get(word_owner(F.col("words")), F.col("o.ref_index"))
    upto = Window.partitionBy("utt_id").orderBy("op").rowsBetween(Window.unboundedPreceding, 0)
    owned = ops.select("utt_id", "op", F.get("heard", F.col("o.hyp_index")).alias("sound"), F.coalesce(F.last(owner, ignorenulls=True).over(upto), F.lit(0)).alias("nth"))
    got = owned.filter("sound is not null").groupBy("utt_id", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("op", "sound"))), lambda s: s["sound"]).alias("heard"))
    words = base.select("utt_id", F.posexplode("words").alias("nth", "target"))
    return words.join(got, ["utt_id", "nth"], "left").withColumn("heard", F.coalesce("heard", F.array().cast("array<string>")))
