"""Value and quality scores of change sets: column arithmetic over one row of measures a change set.

Rates and weights are parameters; the defaults are example values where none are published.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, clamp01, finite, half_up, log_share, smoothstep, tokens_of_lines


@dataclass(frozen=True)
class Rates:
    """What an hour, a defect, a line and a machine cost."""

    hour: float = 75.0
    bug_critical: float = 8.0
    bug_important: float = 3.0
    bug_minor: float = 0.5
    per_finding: float = 0.25
    per_line: float = 0.002
    machine_hour: float = 0.096
    hours_a_month: float = 730.0
    iterations: float = 4.0
    tokens_an_iteration: float = 20_000.0
    usd_a_mtoken: float = 3.0


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def bug_hours(r: Rates) -> Column:
    return _n("critical") * r.bug_critical + _n("important") * r.bug_important + _n("minor") * r.bug_minor


def value_runtime() -> Column:
    """struct(delta, confidence) from perf_commits, added, deleted and the degrading findings by tier (bad_critical, bad_important, bad_minor)."""
    penalty = F.least(_n("bad_critical") * 12 + _n("bad_important") * 6 + _n("bad_minor") * 2, F.lit(60.0))
    hoped = F.when(_n("perf_commits") > 0, F.least(_n("perf_commits") * 15, F.lit(60.0))).when((_n("deleted") > F.floor(_n("added") * 3 / 2)) & (_n("deleted") > 50), 5.0).when(_n("added") > 1000, -3.0).otherwise(0.0)
    return F.greatest(F.lit(-60.0), F.least(F.lit(60.0), hoped - penalty))


def value_money(r: Rates = Rates()) -> Column:
    """struct(cost, savings, delta) in money and percent of an engineer's month."""
    findings = _n("critical") + _n("important") + _n("minor")
    debt = (bug_hours(r) + findings * r.per_finding + _n("added") * r.per_line) * r.hour
    size = F.when(_n("files") == 0, F.lit(0.0)).otherwise(1 + (_n("files") - 1) * 0.3)
    again = F.least(1 + 0.4 * F.least(findings, F.lit(5.0)), F.lit(3.0))
    reading = r.iterations * r.tokens_an_iteration * size * again * (r.usd_a_mtoken / 1e6)
    machine = F.when(F.coalesce(F.col("touches_db"), F.lit(False)), F.lit(r.machine_hour * r.hours_a_month)).otherwise(0.0)
    void = _n("bad_critical") > 0
    perf = F.when((_n("perf_commits") > 0) & ~void, F.lit(r.machine_hour * r.hours_a_month * 12)).otherwise(0.0)
    savings = _n("fix_commits") * (r.bug_important * r.hour) + F.greatest(_n("deleted") - _n("added"), F.lit(0.0)) * (r.per_line * r.hour) + perf
    cost = debt + reading + machine
    return F.struct(cost.alias("cost"), savings.alias("savings"), finite((savings - cost) / (160 * r.hour) * 100).alias("delta"))


def value_ux() -> Column:
    """struct(delta, confidence) from new_tests, fix_commits, docs_commits and critical findings."""
    delta = half_up(F.least(_n("new_tests") * 5 + _n("fix_commits") * 3 + _n("docs_commits") * 4, F.lit(60.0)), 1)
    risky = (_n("critical") > 0) & (_n("new_tests") == 0)
    return F.struct(delta.alias("delta"), F.when(~risky & (_n("new_tests") >= 3), "medium").otherwise("low").alias("confidence"))


def review_effort() -> Column:
    """1 to 5, from points for files, lines, roots, debt sites, findings, regressed axes, risks and missing tests."""

    def steps(x: Column, *cuts: tuple[float, float], rest: float) -> Column:
        out = F.lit(rest)
        for least, points in reversed(cuts):
            out = F.when(x > least, F.lit(points)).otherwise(out)
        return out

    points = (
        steps(_n("files"), (40, 2.0), (15, 1.5), (6, 1.0), rest=0.5)
        + steps(_n("added"), (1000, 2.0), (400, 1.5), (150, 1.0), (0, 0.5), rest=0.0)
        + steps(_n("roots"), (30, 1.0), (12, 0.5), rest=0.0)
        + F.least(F.lit(1.5), _n("debt_sites") * 0.25)
        + F.least(F.lit(2.0), _n("correctness_findings") * 0.9)
        + F.least(F.lit(1.0), _n("regressed_axes") * 0.5)
        + F.least(F.lit(1.0), _n("risks") * 0.2)
        + F.when((_n("new_tests") == 0) & (_n("added") > 150), 0.5).otherwise(0.0)
    )
    return F.when(points >= 7, 5).when(points >= 5, 4).when(points >= 3, 3).when(points >= 1.5, 2).otherwise(1)


def operational_risk(wide_roots: float = 20, hub: float = 50, central: float = 50, rollback=(1.0, 0.6, 0.4, 0.3), blast=(0.4, 0.25, 0.2, 0.15)) -> Column:
    """The risk of shipping: hardest rollback, blast radius, unobserved roots; at least 0.8 with a destructive migration."""
    destructive, blocking = _n("destructive") > 0, _n("blocking") > 0
    back = F.greatest(
        *[F.when(c, F.lit(w)).otherwise(0.0) for c, w in zip((destructive, blocking, _n("removed_files") > 0, F.coalesce(F.col("touches_db"), F.lit(False)) & ~destructive & ~blocking), rollback, strict=True)]
    )
    spread = clamp01(blast[0] * clamp01(_n("roots") / wide_roots) + blast[1] * log_share(_n("max_centrality"), central) + blast[2] * clamp01(_n("max_percent") / 100) + blast[3] * log_share(_n("max_fan_in"), hub))
    blind = F.when(_n("io_roots") > 0, clamp01(_n("blind_roots") / _n("io_roots"))).otherwise(0.0)
    score = clamp01(0.45 * back + 0.35 * spread + 0.20 * blind)
    return F.when(destructive, F.greatest(score, F.lit(0.8))).otherwise(score)


def correctness(no_new_tests: float = 0.6, few_lines: float = 20) -> Column:
    """The weighted geometric mean of coverage, repeatability and edge cases, of which the weakest counts most."""
    reach = F.when(_n("roots") > 0, clamp01(F.greatest(_n("roots") - _n("uncovered_roots"), F.lit(0.0)) / _n("roots"))).otherwise(1.0)
    base = clamp01(reach * F.when(_n("new_tests") > 0, 1.0).otherwise(no_new_tests))
    covered = F.when(_n("added") < few_lines, F.greatest(base, F.lit(0.8))).otherwise(base)
    parts = ((0.45, covered), (0.30, F.coalesce(F.col("repeatability"), F.lit(1.0))), (0.25, F.coalesce(F.col("edge"), F.lit(1.0))))
    return clamp01(F.exp(sum(w * F.log(F.greatest(x, F.lit(0.01))) for w, x in parts)))


def fragility(total_symbols: Column, fan_in: float = 50, fan_out: float = 25, central: float = 50, flow: float = 2.2e7, weights=(0.35, 0.30, 0.20, 0.15)) -> Column:
    """How much hangs on a symbol (call_sites, callees, pagerank, percent_total, loc): its flow is loc * (in * out) squared."""
    middle = F.when(total_symbols > 0, log_share(_n("pagerank") * total_symbols, central)).otherwise(clamp01(_n("percent_total") / 100))
    through = _n("loc") * F.pow(_n("call_sites") * _n("callees"), F.lit(2.0))
    return clamp01(weights[0] * log_share(_n("call_sites"), fan_in) + weights[1] * middle + weights[2] * log_share(through, flow) + weights[3] * log_share(_n("callees"), fan_out))


def weighted_fragility(nodes: DataFrame, group: str, total_symbols: int) -> DataFrame:
    """The mean fragility of a group's symbols by rank; the plain mean where all ranks are 0."""
    f = nodes.withColumn("_f", fragility(F.lit(float(total_symbols)))).withColumn("_w", F.greatest(_n("pagerank"), F.lit(0.0)))
    sums = f.groupBy(group).agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_f")).alias("_wf"), F.avg("_f").alias("_mean"), F.max("_f").alias("worst"))
    return sums.select(group, clamp01(F.when(F.col("_w") > 1e-12, F.col("_wf") / F.col("_w")).otherwise(F.col("_mean"))).alias("fragility"), "worst")


def longevity(r: Rates = Rates(), minutes_a_line: float = 30, todo_full: float = 0.05, hard_full: float = 0.1) -> Column:
    """1 less the risk of ageing: fragility, net debt as a share of what the new lines cost, notes and hard-coded values."""
    debt = bug_hours(r) + (_n("critical") + _n("important") + _n("minor")) * r.per_finding + _n("added") * r.per_line
    paid = (_n("fix_commits") + _n("refactor_commits")) * r.bug_important + F.greatest(_n("deleted") - _n("added"), F.lit(0.0)) * r.per_line
    ratio = clamp01((debt - paid) * 60 / (minutes_a_line * F.greatest(_n("added"), F.lit(1.0))))
    code = F.greatest(_n("code_lines"), F.lit(1.0))
    burden = clamp01(0.5 * clamp01(_n("todos") / code / (3 * todo_full)) + 0.5 * clamp01(_n("magic") / code / hard_full))
    return clamp01(1 - clamp01(0.45 * _n("fragility") + 0.35 * ratio + 0.20 * burden))


def comment_score(density: Column, target: float = 0.20, high: float = 0.40) -> Column:
    """How well commented: none is worst, the band from target to high is best; null is unknown."""
    return F.when(density.isNull(), 0.5).when(density <= 0, 0.3).when(density < target, clamp01(0.3 + 0.7 * density / target)).when(density <= high, 1.0).otherwise(clamp01(1 - (density - high)))


def comprehensibility(magic_budget: float = 0.10) -> Column:
    """From flow, comment_density, naming, magic_ratio, narrative (whether a commit tells why), todos a function, and the cost of context."""
    explain = clamp01(0.45 * _n("flow") + 0.30 * comment_score(F.col("comment_density")) + 0.25 * F.coalesce(F.col("naming"), F.lit(1.0)))
    told = F.when(F.coalesce(F.col("narrative"), F.lit(False)), 1.0).otherwise(0.4)
    clear = clamp01(0.5 * clamp01(1 - _n("magic_ratio") / magic_budget) + 0.5 * told - F.least(clamp01(_n("todos") / F.greatest(_n("functions"), F.lit(1.0))), F.lit(0.3)))
    return clamp01(0.45 * explain + 0.30 * clear + 0.25 * clamp01(1 - _n("context_cost")))


def team_process() -> Column:
    """1 less review fatigue by lines (200 to 400) or files (10 to 50), whichever is worse."""
    return clamp01(1 - F.greatest(smoothstep(_n("added") + _n("deleted"), 200, 400), smoothstep(_n("files"), 10, 50)))


def reviewability(window: float = 1_000_000, usable: float = 0.3, overhead: float = 25_000, files=(10, 50), coupling: float = 100) -> Column:
    """1 less what hinders a reader with a bounded context: tokens, callees, files, scatter."""
    load = (tokens_of_lines(_n("added") + _n("deleted")) + overhead) / (window * usable)
    functions = F.greatest(_n("functions"), F.lit(1.0))
    return clamp01(1 - clamp01(0.45 * clamp01(load) + 0.25 * clamp01(_n("callees") / coupling) + 0.20 * smoothstep(_n("files"), *files) + 0.10 * clamp01(_n("files") / functions)))


def density() -> Column:
    """struct(value, band): tokens of the diff for each logical unit it changes."""
    units = F.greatest(F.greatest(_n("functions"), F.lit(1.0)) + _n("complexity") + _n("findings") + _n("categories"), F.lit(1.0))
    d = tokens_of_lines(_n("added") + _n("deleted")) / units
    return F.struct(half_up(d, 2).alias("value"), F.when(d < 200, "dense").when(d > 800, "boilerplate").otherwise("normal").alias("band"))


#: Gauges: name, column, whether more is better. Risky: over half the way to the bad end.
GAUGES = (
    ("operational_risk", "operational", False), ("rollback", "rollback", False), ("blast_radius", "blast", False), ("observability", "blind", False),
    ("correctness", "correctness", True), ("coverage", "coverage", True), ("repeatability", "repeatability", True), ("edge_cases", "edge", True),
    ("longevity", "longevity", True), ("fragility", "fragility", False), ("net_debt", "debt", False), ("burden", "burden", False),
    ("comprehensibility", "comprehensibility", True), ("explainability", "explain", True), ("context", "context_cost", False),
    ("team_process", "team", True), ("reviewability", "reviewability", True), ("concentration", "concentration", False),
)


def gauges(scores: DataFrame, group: str) -> DataFrame:
    """Rows (group, gauge, value, polarity, band) of the gauges whose column the scores have; null values have no row."""
    rows = [F.struct(F.lit(name).alias("gauge"), F.col(c).cast("double").alias("value"), F.lit("higher" if up else "lower").alias("polarity"), band(F.col(c), up).alias("band")) for name, c, up in GAUGES if c in scores.columns]
    return scores.select(group, F.explode(F.array(*rows)).alias("g")).select(group, "g.*").filter("value is not null")


def risks() -> Column:
    """The risks of a change set, each struct(label, likelihood, severity, quadrant): size, breaking commits, blast radius, untested additions."""

    def risk(label: str, when: Column, likely: Column, severe: Column) -> Column:
        place = F.when((severe >= 0.5) & (likely >= 0.5), "act_before_merge").when(severe >= 0.5, "monitor_closely").when(likely >= 0.5, "document_and_ship").otherwise("acceptable")
        return F.when(when, F.struct(F.lit(label).alias("label"), half_up(likely, 2).alias("likelihood"), half_up(severe, 2).alias("severity"), place.alias("quadrant")))

    one = F.lit(1.0)
    return F.array_compact(F.array(
        risk("size", _n("files") > 0, F.least(_n("files") / 100, one), F.least(_n("files") / 200 + 0.3, one)),
        risk("breaking", _n("breaking_commits") > 0, F.lit(0.85), F.lit(0.9)),
        risk("blast_radius", _n("roots") >= 5, F.least(0.4 + _n("roots") / 50, one), F.least(0.5 + _n("roots") / 40, one)),
        risk("untested", (_n("added") >= 200) & (_n("new_tests") == 0), F.lit(0.6), F.lit(0.7)),
    ))


def composite(weights: dict[str, float], floor: float = 0.01) -> Column:
    """The weighted geometric mean of score columns."""
    total = sum(weights.values())
    return F.exp(sum(F.lit(w / total) * F.log(F.greatest(_n(c), F.lit(floor))) for c, w in weights.items()))
