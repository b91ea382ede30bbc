"""The view of a monitor: verdicts, emissions and counts as tables, and a description of what is monitored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.operators.sync import STRATEGIES, increasing
from tempora.plans.formula import Formula
from tempora.plans.notation import formula as read

SEMANTICS = ("delayed_bool", "delayed_rob", "eager", "interval")


class Variables:
    """Named thresholds; a value holds for samples that arrive from ``since`` on."""

    def __init__(self, **values: float):
        self.history: dict[str, list[tuple[int, float]]] = {k: [(-(2**62), float(v))] for k, v in values.items()}

    def set(self, name: str, value: float, since: int | None = None) -> None:
        if since is None:
            self.history[name] = [(-(2**62), float(value))]
        else:
            self.history.setdefault(name, []).append((since, float(value)))

    def get(self, name: str) -> float | None:
        return self.history[name][-1][1] if name in self.history else None

    def contains(self, name: str) -> bool:
        return name in self.history

    def names(self) -> list[str]:
        return sorted(self.history)

    def remove(self, name: str) -> None:
        self.history.pop(name, None)

    def clear(self) -> None:
        self.history.clear()

    def __len__(self) -> int:
        return len(self.history)


@dataclass
class Monitor:
    """A formula with its semantics, evaluated on traces."""

    formula: Formula | str
    semantics: str = "delayed_rob"
    synchronize: str = "zoh"
    variables: Variables = field(default_factory=Variables)

    def __post_init__(self):
        if isinstance(self.formula, str):
            self.formula = read(self.formula)
        if self.semantics not in SEMANTICS:
            raise ValueError(f"semantics is one of {SEMANTICS}")
        if self.synchronize not in STRATEGIES:
            raise ValueError(f"synchronize is one of {STRATEGIES}")

    @property
    def specification(self) -> str:
        return str(self.formula)

    @property
    def temporal_depth(self) -> float:
        """Seconds after t that a verdict for t waits for."""
        return self.formula.depth() / 1_000_000

    @property
    def signal_identifiers(self) -> list[str]:
        return self.formula.signals()

    def __str__(self) -> str:
        lines = [f"Monitor of {self.specification}", f"  semantics: {self.semantics}", f"  synchronize: {self.synchronize}", f"  temporal depth: {self.temporal_depth:g} s"]
        return "\n".join(lines + [f"  ${n} = {self.variables.get(n):g}" for n in self.variables.names()])

    @property
    def synchronization_strategy(self) -> str:
        return self.synchronize

    @property
    def variable_names(self) -> list[str]:
        """The variables that the formula asks for."""
        return self.formula.variables()

    def _options(self) -> dict:
        return {"synchronize": self.synchronize, "bindings": self.variables.history}

    def emissions(self, trace: DataFrame) -> DataFrame:
        """Every emission: key, t_us, value (or lo and hi) and the arrival or time at which it was made."""
        if self.semantics == "eager":
            return E.eager(trace, self.formula, **self._options())
        if self.semantics == "interval":
            return E.interval_trace(trace, self.formula, **self._options())
        return E.verdicts(trace, self.formula, self.semantics.removeprefix("delayed_"), emission=True, **self._options())

    def verdicts(self, trace: DataFrame) -> DataFrame:
        """The latest value of each time."""
        if self.semantics == "interval":
            return E.intervals(trace, self.formula, **self._options())
        return self.emissions(trace).drop("at_seq")

    def verdict_at(self, trace: DataFrame, t_us: int) -> DataFrame:
        return self.verdicts(trace).where(F.col("t_us") == t_us)

    def has_verdicts(self, trace: DataFrame) -> DataFrame:
        """Per key of the trace, whether any time has a verdict."""
        some = self.verdicts(trace).select("key").distinct().withColumn("_some", F.lit(True))
        return trace.select("key").distinct().join(some, "key", "left").select("key", F.coalesce("_some", F.lit(False)).alias("has_verdicts"))

    def has_outputs(self, trace: DataFrame) -> DataFrame:
        """Per sample, whether its arrival brought verdicts."""
        return self.records(trace).select("key", "t_us", "seq", (F.size("outputs") > 0).alias("has_outputs"))

    def display(self, trace: DataFrame) -> DataFrame:
        """Per verdict, a line of text: time in seconds, and the value or interval."""
        out, seconds = self.verdicts(trace), F.format_string("%.6f", F.col("t_us") / 1_000_000)
        value = F.format_string("[%s, %s]", F.col("lo").cast("string"), F.col("hi").cast("string")) if "lo" in out.columns else F.col("value").cast("string")
        return out.select("key", "t_us", F.concat(F.lit("t="), seconds, F.lit("s: "), value).alias("line"))

    def records(self, trace: DataFrame) -> DataFrame:
        """Each sample with the verdicts that its arrival brought (none: an empty list): a nested row per input."""
        if self.semantics == "interval":
            raise ValueError("intervals are refined with time, not by single arrivals: see interval_trace")
        brought = self.evaluations(trace).withColumnRenamed("at", "seq")
        none = F.array().cast(brought.schema["outputs"].dataType)
        return trace.join(brought, ["key", "seq"], "left").select("key", "signal", "t_us", "value", "seq", F.coalesce("outputs", none).alias("outputs"))

    def latest(self, trace: DataFrame) -> DataFrame:
        """Per key, the verdict emitted last."""
        out = self.emissions(trace)
        when = "now_us" if "now_us" in out.columns else "at_seq"
        rest = [c for c in out.columns if c != "key"]
        return out.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(when, "t_us")).alias("v")).select("key", "v.*")

    def counts(self, trace: DataFrame) -> DataFrame:
        """Per key: emissions, and times with a verdict."""
        return self.emissions(trace).groupBy("key").agg(F.count("*").alias("n_emissions"), F.countDistinct("t_us").alias("n_verdicts"))

    def dropped(self, trace: DataFrame) -> DataFrame:
        """Samples that no operator sees: other signals, or not later than one of their signal before."""
        own = trace.where(F.col("signal").isin(self.signal_identifiers)) if self.signal_identifiers else trace
        return trace.join(increasing(own).select("key", "signal", "seq"), ["key", "signal", "seq"], "left_anti")

    def evaluations(self, trace: DataFrame) -> DataFrame:
        """Per arrival, the verdicts it brought, in order of time: key, at, outputs."""
        out = self.emissions(trace)
        when = "now_us" if "now_us" in out.columns else "at_seq"
        rest = [c for c in out.columns if c not in ("key", when)]
        return out.groupBy("key", F.col(when).alias("at")).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("outputs"))
