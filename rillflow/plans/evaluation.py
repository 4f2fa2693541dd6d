"""Whole evaluations from a configuration file: read records, build a sketch, measure it, report.

Sections (all dotted paths are under the section's name):

[<Section>.para]  the sketch's parameters, by the names of ``operators.sketch`` or of the format
[<Section>.ch]    more of them, for a sketch over the counter hierarchy
[<Section>.data]  data = path, format = [[names], [lengths]], cnt_method = "InLength" | "InPacket", hx_method = "TopK" | "Percentile",
                  threshold_heavy_hitter, threshold_heavy_changer
[<Section>.test]  sample, and the metrics of each routine: insert, update = ["RATE"], query, lookup, heavyhitter, heavychanger, decode = [...];
                  <routine>_podf, <routine>_dist

Every routine that the test section names is run, whatever the sketch: through
the contract of ``Sketch``, where what a sketch lacks finds nothing.  Flows are
told apart by the bytes of their keys.  An unknown method falls back to InLength
and TopK; look-ups, insertions and decoding count packets.  A metric that a
routine doesn't know is ignored; DIST and PODF need their companion key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import exact, sketch
from ..sources.config import Config
from ..sources.formats import RecordFormat, read_records

KEYS = ["key"]


def wanted(config: Config, routine: str) -> tuple[set[str], float | None, list[float] | None]:
    """Metrics asked for and allowed, the PODF threshold and the DIST ticks."""
    asked = {m for m in config.get(routine, list[str], False) or [] if m in ev.METRICS and m in ev.ROUTINES[routine]}
    podf, dist = config.get(f"{routine}_podf", float, False), config.get(f"{routine}_dist", list[float], False)
    if podf is None:
        asked.discard("PODF")
    if dist is None:
        asked.discard("DIST")
    return asked, podf if "PODF" in asked else None, ev.ticks(dist) if "DIST" in asked else None


def clocked(config: Config, routine: str, rows: int, *frames: DataFrame) -> dict[str, float]:
    """TIME and RATE of a routine, where asked for: each frame is computed once as a whole."""
    asked = wanted(config, routine)[0] & {"TIME", "RATE"}
    if not asked:
        return {}
    got = ev.timed(lambda: [f.write.format("noop").mode("overwrite").save() for f in frames], rows)
    return {k: got[k] for k in asked}


def measured(frame: DataFrame) -> dict[str, object]:
    return {k.upper(): v for k, v in frame.first().asDict().items()}


def evaluate(spark: SparkSession, path: str, section: str, name: str) -> dict[str, dict[str, object]]:
    """Metrics by routine of one sketch; ValueError where the configuration lacks something."""
    config = Config(path)
    para, more, data, test = (config.at(f"{section}.{s}") for s in ("para", "ch", "data", "test"))
    if not config.succeed or not para.exists or not data.exists:
        raise ValueError(f"no sections of {section} in {path}")
    given = para.items() | (more.items() if name == "hierarchy_count_min" else {})
    made = sketch.create(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    spec, source = data.get("format", list), data.get("data", str)
    if spec is None or source is None:
        raise ValueError(f"no data and format of {section} in {path}")
    fmt = RecordFormat.parse(spec)
    asked = [r for r in ev.ROUTINES if test.get(r, list[str], False) is not None]
    by = "length" if data.get("cnt_method", str, False) != "InPacket" and set(asked) & {"query", "heavyhitter", "heavychanger"} else "packets"
    if by == "length" and "length" not in fmt.names:
        raise ValueError("lengths are counted, but the format has none")
    records = read_records(spark, source, fmt).withColumnRenamed("flowkey", "key")
    flows = lambda rows, by=by: exact.ground_truth(rows, KEYS, by)
    reads = lambda rows: flows(rows) if made.takes == "flows" else rows.withColumn("value", exact.weight(by))
    held: list[DataFrame] = []

    def hold(frame: DataFrame) -> DataFrame:
        held.append(frame.cache())
        return frame

    try:
        truth = hold(flows(records))
        packets, found = records.count(), truth.count()
        out: dict[str, dict[str, object]] = {"size": {"SIZE": made.size}}
        state = None
        if set(asked) & {"update", "query", "heavyhitter", "decode"}:
            state = hold(made.build(reads(records)))
            out["update"] = clocked(test, "update", packets, state)
        for routine in asked:
            metrics, podf, ticks = wanted(test, routine)
            got: dict[str, object] = {}
            if routine == "query":
                joined = hold(made.query(state, truth.select("key", "value")))
                got = clocked(test, routine, found, joined) | measured(ev.errors(joined, podf))
                if ticks:
                    got["DIST"] = [tuple(r) for r in ev.distribution(joined, ticks).orderBy("tick").collect()]
            elif routine in ("insert", "lookup") and "lookup" not in out:
                share = test.get("sample", float, False) or 0.3
                sample = exact.prefix(records, share)
                built = hold(made.build(exact.ground_truth(sample, KEYS) if made.takes == "flows" else sample.withColumn("value", exact.weight(by))))
                out["insert"] = clocked(test, "insert", int(share * packets), built)
                looked = made.lookup(built, truth).join(sample.select("key").distinct().withColumn("m", F.lit(True)), "key", "left")
                looked = looked.select("found", F.coalesce("m", F.lit(False)).alias("member"))
                metrics = wanted(test, "lookup")[0]
                out["lookup"] = {k: v for k, v in (clocked(test, "lookup", found, looked) | measured(ev.lookups(looked))).items() if k in metrics}
                continue
            elif routine in ("heavyhitter", "heavychanger"):
                method, threshold = hitters(data, "threshold_heavy_hitter" if routine == "heavyhitter" else "threshold_heavy_changer")
                if routine == "heavyhitter":
                    real, total = exact.heavy_hitters(truth, threshold, method), truth
                    find = lambda cut: made.heavy_hitters(state, cut)
                else:
                    one, two = exact.halves(records)
                    total = hold(exact.record_differences(one, two, KEYS, by))
                    real = exact.heavy_changers(total, KEYS, threshold, method)
                    states = [hold(made.build(reads(x))) for x in (one, two)]
                    find = lambda cut: made.changers(*states, cut)
                # the sketch reports from a value on, the exact answer over a share: so one more than the share's cut
                least = real.agg(F.min("value")) if method == "topk" else total.agg(F.floor(F.lit(threshold) * F.sum("value") + 1).cast("long"))
                detected = fitting(find(least.first()[0] or 1), truth)
                got = clocked(test, routine, 1, detected) | measured(ev.detections(real, detected, KEYS))
            elif routine == "decode":
                decoded = hold(fitting(made.decode(state), truth))
                got = clocked(test, routine, 1, decoded) | measured(ev.decodings(truth, decoded, KEYS, podf or 0.0))
                if ticks:
                    got["DIST"] = [tuple(r) for r in ev.decoded_distribution(truth, decoded, KEYS, ticks).orderBy("tick").collect()]
            else:
                continue
            out[routine] = {k: v for k, v in got.items() if k in metrics}
        return out
    finally:
        for frame in held:
            frame.unpersist()


def fitting(found: DataFrame, truth: DataFrame) -> DataFrame:
    """What a sketch found, with keys of the truth's type (that nothing was found says nothing of the keys' type)."""
    kind = truth.schema["key"].dataType
    return found if found.schema["key"].dataType == kind else found.select(F.lit(None).cast(kind).alias("key"), "est")


def hitters(data: Config, threshold: str) -> tuple[str, float]:
    """Method and threshold of heavy hitters or changers; ValueError without the threshold."""
    value = data.get(threshold, float)
    if value is None:
        raise ValueError(f"no {threshold}")
    return ("percentile" if data.get("hx_method", str, False) == "Percentile" else "topk"), value
