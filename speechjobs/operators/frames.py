"""Frame-level time series: decoding posteriors, finding speech, measuring takes, pooling layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_SECONDS, LAST_FRAMES = 0.02, 6
SAMPLE_RATE, FRAME, HOP = 16000, 320, 160
FLOOR_DB, LOUD_DB, ABOVE_NOISE, BELOW_PEAK, LEAST_RANGE = -80.0, -35.0, 6.0, 32.0, 6.0
RUN, GAP, GROUP, PAD, CLIP = 4, 35, 12, 0.5, 0.985
CUTOFF_HZ = 70.0
#: Samples of a block of the scan; recordings that are filtered at once.
BLOCK, AT_ONCE = 256, 32
#: Pieces before one whose state still counts: each fades by a^FRAME at least, so after these by under 1e-30.
KEPT = 8


def collapse(frames: DataFrame, blank: int) -> DataFrame:
    """(take_id, frame, token, top, lead, n_frames): frames whose winning token is new and not blank. top and lead are the
    winner's probability and its distance to the runner-up. The first of equal winners wins."""
    order = Window.partitionBy("take_id").orderBy("frame")
    best = F.array_max("logits")
    won = frames.withColumns({"token": (F.array_position("logits", best) - 1).cast("int"), "peak": best})
    new = won.withColumns({"before": F.lag("token").over(order), "n_frames": F.count("*").over(Window.partitionBy("take_id"))}).filter(~F.col("token").eqNullSafe(F.col("before")) & (F.col("token") != blank))
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("peak")).cast("double")))
    second = F.get(F.sort_array("logits", False), F.lit(1))
    return new.select("take_id", "frame", "token", (1 / total).alias("top"), ((1 - F.exp((second - F.col("peak")).cast("double"))) / total).alias("lead"), "n_frames")


def decode(frames: DataFrame, symbols: dict[int, str], special: tuple[int, ...] = (), blank: int = 0) -> DataFrame:
    """(take_id, phonemes, spans, confidence, margin) of every take. A sound lasts until the next kept one starts; the last
    one six frames at most. Confidence and margin are means over all frames that collapse keeps; 0 where there are none."""
    kept = collapse(frames, blank)
    names = F.create_map(*[x for k, v in symbols.items() for x in (F.lit(k), F.lit(v))])
    order = Window.partitionBy("take_id").orderBy("frame")
    sounds = kept.filter(~F.col("token").isin(list(special))) if special else kept
    ends = F.coalesce(F.lead("frame").over(order), F.least(F.col("frame") + LAST_FRAMES, F.col("n_frames")))
    seconds = lambda x: F.bround(x * FRAME_SECONDS, 3)
    timed = sounds.select("take_id", F.struct("frame", names[F.col("token")].alias("symbol"), F.struct(seconds(F.col("frame")).alias("start"), seconds(ends).alias("end")).alias("span")).alias("s"))
    listed = timed.groupBy("take_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("take_id", F.transform("s", lambda s: s["symbol"]).alias("phonemes"), F.transform("s", lambda s: s["span"]).alias("spans"))
    signals = kept.groupBy("take_id").agg(F.avg("top").alias("confidence"), F.avg("lead").alias("margin"))
    takes = frames.select("take_id").distinct().join(listed, "take_id", "left").join(signals, "take_id", "left")
    return takes.select("take_id", F.coalesce("phonemes", F.array().cast("array<string>")).alias("phonemes"), F.coalesce("spans", F.array().cast("array<struct<start:double,end:double>>")).alias("spans"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


def nearest_rank(ordered: Column, fraction: float) -> Column:
    """Element floor(fraction * (n - 1)) of a sorted array."""
    return F.get(ordered, F.floor(F.lit(fraction) * (F.size(ordered) - 1)).cast("int"))


def speech_frames(levels: DataFrame) -> DataFrame:
    """``levels`` (rec_id, frame from 0, level_db) with ``speech``, ``floor`` and ``found``.

    Active frames stand clear of the noise floor and near the peak. Runs of four or more count; runs are grouped where
    silences between them last over 35 frames, short groups apart from the largest are dropped, and everything from the
    first kept group to the last is speech. A flat recording is all speech if it is loud, else none. Each step is a
    window over one recording.
    """
    rec, order = Window.partitionBy("rec_id"), Window.partitionBy("rec_id").orderBy("frame")
    facts = levels.groupBy("rec_id").agg(F.sort_array(F.collect_list("level_db")).alias("s")).select("rec_id", F.size("s").alias("n"), nearest_rank(F.col("s"), 0.1).alias("floor"), nearest_rank(F.col("s"), 0.95).alias("peak"))
    base = levels.join(facts, "rec_id")
    flat = F.col("peak") - F.col("floor") < LEAST_RANGE
    active = base.withColumn("on", F.col("level_db") > F.greatest(F.col("floor") + ABOVE_NOISE, F.col("peak") - BELOW_PEAK))
    runs = active.filter("on").withColumn("island", F.col("frame") - F.row_number().over(order))
    long = runs.withColumn("len", F.count("*").over(Window.partitionBy("rec_id", "island"))).filter(F.col("len") >= RUN)
    apart = long.withColumn("new", F.coalesce(F.col("frame") - F.lag("frame").over(order) > GAP, F.lit(True)).cast("int"))
    groups = apart.withColumn("group", F.sum("new").over(order)).groupBy("rec_id", "group").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("size"))
    solid = groups.withColumn("most", F.max("size").over(rec)).filter((F.col("size") >= GROUP) | (F.col("size") == F.col("most")))
    regions = solid.groupBy("rec_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    joined = base.join(regions, "rec_id", "left")
    inside = F.coalesce(F.col("frame").between(F.col("first"), F.col("last")), F.lit(False))
    speech = F.when(F.col("n") < RUN, F.lit(False)).when(flat, F.col("floor") > LOUD_DB).otherwise(inside)
    marked = joined.withColumn("speech", speech)
    return marked.withColumn("found", F.max("speech").over(rec)).select("rec_id", "frame", "level_db", "speech", "floor", "found")


def take_quality(levels: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec_id, found_speech, start, end, speech_seconds, snr_db) from frame levels and (rec_id, n_samples)."""
    marked = speech_frames(levels)
    outside = F.sort_array(F.collect_list(F.when(~F.col("speech"), F.col("level_db"))))
    power = F.avg(F.when(F.col("speech"), F.pow(F.lit(10.0), F.col("level_db") / 10)))
    g = marked.groupBy("rec_id").agg(F.max("found").alias("found"), F.min(F.when(F.col("speech"), F.col("frame"))).alias("a"), F.max(F.when(F.col("speech"), F.col("frame"))).alias("b"), power.alias("power"), outside.alias("outside"), F.first("floor").alias("floor"))
    g = g.join(lengths, "rec_id").withColumns({"s": F.col("a") * HOP, "e": F.least(F.col("n_samples"), F.col("b") * HOP + FRAME)})
    noise = F.when(F.size("outside") >= RUN, nearest_rank(F.col("outside"), 0.5)).otherwise(F.col("floor"))
    pad = int(PAD * SAMPLE_RATE)
    found = F.col("found")
    return g.select(
        "rec_id", found.alias("found_speech"), F.when(found, F.greatest(F.lit(0), F.col("s") - pad)).otherwise(0).alias("start"), F.when(found, F.least(F.col("n_samples"), F.col("e") + pad)).otherwise(F.col("n_samples")).alias("end"),
        F.when(found, F.bround((F.col("e") - F.col("s")) / SAMPLE_RATE, 3)).otherwise(0.0).alias("speech_seconds"),
        F.when(found, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(60.0), 10 * F.log10("power") - noise)), 1)).otherwise(0.0).alias("snr_db"),
    )


def clipped_share(samples: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(samples, lambda x: F.abs(x) >= CLIP)), F.size(samples)), F.lit(0.0))


def decay() -> float:
    """What a high-pass at CUTOFF_HZ keeps of its state from one sample to the next."""
    rc = 1 / (2 * np.pi * CUTOFF_HZ)
    return rc / (rc + 1 / SAMPLE_RATE)


def high_pass(samples: list[np.ndarray], carries: np.ndarray) -> list[np.ndarray]:
    """y[t] = a (y[t-1] + x[t] - x[t-1]) of several recordings at once; ``carries``: y - x before each one's first sample.

    A blocked scan. Within a block the steps are summed with weights a^-t, for all blocks of all recordings together; the state
    then goes from block to block, again for all recordings together. Blocks are short enough for the weights to stay
    small, so the result is that of the plain loop but for rounding.
    """
    a, sizes = decay(), np.array([len(x) for x in samples])
    blocks = -(-sizes // BLOCK)
    steps = np.zeros((len(samples), int(blocks.max(initial=0)), BLOCK))
    for row, x in zip(steps.reshape(len(samples), -1), samples, strict=True):
        row[: len(x)] = np.diff(x, prepend=0.0)
    weights = a ** np.arange(BLOCK)
    out = np.cumsum(steps / weights, axis=2) * (a * weights)
    state = np.asarray(carries, float).copy()
    for k in range(out.shape[1]):
        out[:, k] += state[:, None] * (a * weights)
        state = out[:, k, -1].copy()
    return [row[:n] for row, n in zip(out.reshape(len(samples), -1), sizes.tolist(), strict=True)]


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of pieces: rec_id, offset (of the piece in its recording), carry, own (samples of the piece itself) and samples
    (the piece, and what frames that begin in it need of the next)."""
    for batch in batches:
        for rows in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows // AT_ONCE)) if batch.num_rows else ():
            part = batch.slice(int(rows[0]), len(rows))
            samples = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32).astype(float) if x.is_valid else np.zeros(0) for x in part["samples"]]
            found = high_pass(samples, part["carry"].to_numpy())
            out: list[list] = [[], [], []]
            for rec, offset, own, y in zip(part["rec_id"].to_pylist(), part["offset"].to_pylist(), part["own"].to_pylist(), found, strict=True):
                first = -(-offset // HOP)  # frames that begin in this piece
                starts = np.arange(first * HOP - offset, min(own, len(y) - FRAME + 1), HOP)
                if len(starts):
                    power = np.lib.stride_tricks.sliding_window_view(y.astype(np.float32).astype(float) ** 2, FRAME)[starts].mean(1)
                    out[0] += [rec] * len(starts)
                    out[1].append(first + np.arange(len(starts), dtype=np.int32))
                    out[2].append(np.maximum(FLOOR_DB, 10 * np.log10(np.maximum(power, 1e-300))))
            if out[0]:
                yield pa.RecordBatch.from_pydict({"rec_id": out[0], "frame": np.concatenate(out[1]), "level_db": np.concatenate(out[2])})


LEVELS = "rec_id string, frame int, level_db double"


def frame_levels(recordings: DataFrame) -> DataFrame:
    """(rec_id, frame, level_db) of (rec_id, samples): energy of 20 ms frames every 10 ms after a 70 Hz high-pass. Null
    and short recordings have no frames."""
    whole = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    return recordings.select(F.col("rec_id").cast("string").alias("rec_id"), F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("carry"), whole.alias("own"), "samples").mapInArrow(_levels, LEVELS)


def frame_levels_of_pieces(pieces: DataFrame) -> DataFrame:
    """The same of recordings in pieces, (rec_id, piece, samples), in the order of ``piece``: a recording of any length is
    spread over tasks.

    Tasks first filter each piece as if nothing came before it. What the filter's state adds is a power of its decay, so
    the states before all pieces follow from one number a piece. Every piece but a recording's last must have at least FRAME
    samples, so that the frames that begin in it end in the next.
    """
    named = pieces.select(F.col("rec_id").cast("string").alias("rec_id"), "piece", F.col("samples").cast("array<float>").alias("samples"))

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid else np.zeros(0) for x in batch["samples"]]
            found = high_pass(samples, np.zeros(len(samples))) if samples else []
            adds = [float(y[-1] - x[-1]) if len(x) else 0.0 for x, y in zip(samples, found, strict=True)]
            yield pa.RecordBatch.from_pydict({"rec_id": batch["rec_id"], "piece": batch["piece"], "n": pa.array([len(x) for x in samples], pa.int64()), "adds": pa.array(adds, pa.float64())})

    kind = named.schema["piece"].dataType.simpleString()
    facts = named.mapInArrow(respond, f"rec_id string, piece {kind}, n long, adds double")
    before = Window.partitionBy("rec_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # state before a piece: what each earlier one added, faded by the samples since its end
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    last = Window.partitionBy("rec_id").orderBy("piece")
    placed = facts.withColumns({"offset": offset, "is_last": F.lead("piece").over(last).isNull()}).withColumn("end", F.col("offset") + F.col("n"))
    earlier = F.collect_list(F.struct("end", "adds")).over(before.rowsBetween(-KEPT, -1))
    faded = lambda s, e: s + e["adds"] * F.pow(F.lit(decay()), F.col("offset") - e["end"])
    placed = placed.withColumn("carry", F.aggregate(earlier, F.lit(0.0), faded))
    short = ~F.col("is_last") & (F.col("n") < FRAME)
    checked = placed.withColumn("offset", F.when(short, F.raise_error(F.lit(f"only the last piece of a recording may have under {FRAME} samples")).cast("long")).otherwise(F.col("offset")))
    heads = named.select("rec_id", "piece", F.slice("samples", 1, FRAME).alias("head"))
    following = heads.withColumns({"head": F.lead("head").over(last)}).select("rec_id", "piece", "head")
    joined = named.join(checked.select("rec_id", "piece", "offset", "carry", F.col("n").alias("own")), ["rec_id", "piece"]).join(following, ["rec_id", "piece"])
    return joined.select("rec_id", "offset", "carry", "own", F.concat("samples", F.coalesce("head", F.array().cast("array<float>"))).alias("samples")).mapInArrow(_levels, LEVELS)


def pool_layers(frames: DataFrame, seconds: int = 50) -> DataFrame:
    """(speaker, utt, layer, window, dim, mean, std): mean and sample deviation of each dimension over the clip (window 0)
    and over one-second windows at its start, middle and end (1 to 3); a frame may be in several. hidden: array."""
    n = F.count("*").over(Window.partitionBy("speaker", "utt", "layer"))
    placed = frames.withColumn("n", n).withColumn("mid", F.greatest(F.lit(0), F.floor((F.col("n") - seconds) / 2)))
    inside = F.array_compact(F.array(F.lit(0), F.when(F.col("frame") < seconds, 1), F.when(F.col("frame").between(F.col("mid"), F.col("mid") + seconds - 1), 2), F.when(F.col("frame") >= F.col("n") - seconds, 3)))
    rows = placed.withColumn("window", F.explode(inside)).select("speaker", "utt", "layer", "window", F.posexplode("hidden").alias("dim", "x"))
    return rows.groupBy("speaker", "utt", "layer", "window", "dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
