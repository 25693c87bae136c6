"""End-to-end runs composed from the operators: baseline, triage, overfitting gates, probes."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import Research
from barline.operators import features as feat
from barline.operators import labels as lab
from barline.operators import metrics as met
from barline.operators import models as mod
from barline.operators import splits as spl
from barline.sources.artifacts import ArtifactStore, Metadata, append_results


#: Symbols that the identity of a model can name; more are refused, none is left out.
MAX_SYMBOLS = 1_000_000


@dataclass(frozen=True)
class BaselineResult:
    metrics: DataFrame
    scores: DataFrame
    split: DataFrame
    model: object
    model_hash: str


def _dataset(bars: DataFrame, matrix: DataFrame, names: tuple[str, ...], horizon: int) -> DataFrame:
    # read by the split checks, every boosting round and the scoring
    return mod.assemble(matrix, lab.forward_returns(bars, horizon), names).persist()


def _scored(data: DataFrame, names: tuple[str, ...], cfg: Research) -> tuple[object, DataFrame, DataFrame]:
    train, test = spl.embargo_split(data, cfg.train_end, cfg.test_start, cfg.horizon, embargo=cfg.embargo)
    model = mod.fit_regressor(train, names, cfg)
    return model, mod.predict_scores(model, test, names), spl.summary(spl.with_role(data, cfg.train_end, cfg.test_start))


def run_baseline(bars: DataFrame, cfg: Research, names: tuple[str, ...] = feat.PRODUCTION, store: ArtifactStore | None = None, strategy: str = "baseline") -> BaselineResult:
    """Features, forward returns, embargoed split, boosted trees, information coefficients.

    With ``store`` the model is saved there under ``strategy`` and its hash, beside it a sidecar of the
    metrics and the split; a hash that the store holds already is an error, before anything is fitted.
    """
    symbols = [r[0] for r in bars.select("symbol").distinct().orderBy("symbol").limit(MAX_SYMBOLS + 1).collect()]
    if len(symbols) > MAX_SYMBOLS:
        raise ValueError(f"the identity of a model names its symbols: at most {MAX_SYMBOLS}")
    digest = mod.identity_hash(names, mod.parameters(cfg), symbols, cfg.train_end, cfg.test_start, "1d", cfg.seed)
    if store is not None:
        store.refuse(strategy, digest)
    data = _dataset(bars, feat.production_matrix(bars), names, cfg.horizon)
    model, scores, split = _scored(data, names, cfg)
    summary = met.ic_summary(met.ic_by_date(scores), min_breadth=cfg.min_breadth, threshold=cfg.ic_threshold)
    if store is not None:
        store.save(model, Metadata(strategy, tuple(names), mod.parameters(cfg), tuple(symbols), cfg.train_end.isoformat(), cfg.test_start.isoformat(), "1d", cfg.seed, digest))
        # one row of metrics, two of the split
        store.write_sidecar(digest, {"horizon": cfg.horizon, "embargo": cfg.embargo, "metrics": summary.first().asDict(), "split": [r.asDict() for r in split.collect()]})
    return BaselineResult(summary, scores, split, model, digest)


def _fold_parts(data: DataFrame, roles: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    own = roles.where(F.col("fold_id") == fold)
    keyed = data.join(own.select("timestamp", "symbol", "role"), ["timestamp", "symbol"])
    return keyed.where("role = 'train'").drop("role"), keyed.where("role = 'test'").drop("role")


def _paths(data: DataFrame, roles: DataFrame, n_folds: int, one) -> DataFrame:
    """Union of the path returns of all folds, which are fitted side by side; the number of folds is fixed
    by the parameters."""

    def path(fold: int) -> DataFrame:
        return one(*_fold_parts(data, roles, fold)).withColumn("fold_id", F.lit(fold))

    return reduce(DataFrame.unionByName, mod.at_once(data.sparkSession, [partial(path, fold) for fold in range(n_folds)]))


@dataclass(frozen=True)
class GateResult:
    paths: DataFrame
    merged: DataFrame
    deflated: met.Deflated

    def path_sharpe(self) -> DataFrame:
        """One row: mean and sample deviation of the Sharpe ratios of the paths (0 for a single one)."""
        own = met.sharpe_moments(self.paths, keys=("fold_id",))
        return own.agg(F.avg("sharpe").alias("mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std"))


def overfitting_gate(data: DataFrame, names: tuple[str, ...], cfg: Research, *, variance: float, trials: int, n: int = 6, k: int = 2, trading: DataFrame | None = None) -> GateResult:
    """Out-of-sample returns of every fold, merged by date and deflated.

    ``data`` has (timestamp, symbol, label, features).  Every row must have a label end on the calendar
    ``trading`` (timestamp), or on its symbol's own rows without one; a row that has none is an error.
    """
    placed = spl.label_ends(data, cfg.horizon, trading).persist()
    if not placed.where("t1 is null or timestamp is null").isEmpty():
        raise spl.SplitError("rows without a label end: the calendar must reach the horizon beyond them")
    data = placed.drop("t1")
    roles = spl.check_cpcv(placed, spl.cpcv_roles(placed, n=n, k=k, embargo=cfg.embargo)).cache()

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        model = mod.fit_regressor(train, names, cfg)
        return met.portfolio_returns(mod.predict_scores(model, test, names))

    paths = _paths(data, roles, math.comb(n, k), one)
    merged = met.merge_paths(paths)
    return GateResult(paths, merged, met.deflated_from_returns(merged, variance, trials))


def check_candidate(names: tuple[str, ...]) -> None:
    """The gate's candidate is the 15 new features in order, none of production."""
    if tuple(names) != feat.NEW or len(names) != 15 or set(names) & set(feat.PRODUCTION):
        raise ValueError("the candidate must be the 15 new features")


def all_new_dataset(bars: DataFrame, horizon: int) -> DataFrame:
    """The 15 new features with forward returns of ``horizon``."""
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    return mod.assemble(feat.combined_matrix(bars), lab.forward_returns(bars, horizon), feat.NEW)


def all_new_gate(bars: DataFrame, cfg: Research, *, variance: float, trials: int, names: tuple[str, ...] = feat.NEW) -> GateResult:
    """The overfitting gate of the new features: 15 folds of 6 blocks, the embargo as long as the horizon,
    label ends on the calendar of all bars."""
    check_candidate(names)
    own = replace(cfg, embargo=cfg.horizon)
    data = all_new_dataset(bars, cfg.horizon)
    return overfitting_gate(data, feat.NEW, own, variance=variance, trials=trials, n=6, k=2, trading=bars)


def meta_gate(data: DataFrame, names: tuple[str, ...], cfg: Research, *, variance: float, trials: int, n: int = 6, k: int = 2, threshold: float = 0.5) -> GateResult:
    """The same for accepted bets: ``data`` has label, ret and t1 of each event."""
    roles = spl.check_cpcv(data, spl.cpcv_roles(data, n=n, k=k, embargo=cfg.embargo)).cache()

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        model = mod.fit_classifier(train, names, cfg)
        return met.accepted_returns(mod.predict_proba(model, test, names), threshold)

    paths = _paths(data, roles, math.comb(n, k), one)
    merged = met.merge_paths(paths)
    return GateResult(paths, merged, met.deflated_from_returns(merged, variance, trials))


def permutation_null(data: DataFrame, run, seed: int, permutations: int, done: DataFrame | None = None, path: str | None = None) -> list[tuple[int, float]]:
    """(perm_id, dsr) of ``run`` on labels dealt anew within dates; ids in ``done`` are skipped.

    With ``path`` each result is added to the table there as soon as it is known.
    """
    skip = {r[0] for r in done.select("perm_id").collect()} if done is not None else set()
    out = []
    for perm in range(permutations):
        if perm not in skip:
            out.append((perm, run(met.permute_within_dates(data, seed, perm)).deflated.dsr))
            if path is not None:
                append_results(data.sparkSession.createDataFrame(out[-1:], "perm_id int, dsr double"), path)
    return out


def triage(bars: DataFrame, cfg: Research, horizons: tuple[int, ...] = (2, 21), arms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row for each arm and horizon: coefficients, breadth and the Grinold proxy.  The models are fitted
    side by side."""
    # read by the features, the labels and the starts of every arm and horizon
    bars = bars.persist()
    matrix = feat.combined_matrix(bars).persist()
    matrix.count()  # once, before all ask for it

    def row(order: int, arm: str, names: tuple[str, ...], h: int) -> DataFrame:
        data = _dataset(bars, matrix, names, h)
        own = replace(cfg, horizon=h, embargo=max(h, cfg.embargo), test_start=settle_start(cfg, h, bars, data))
        _, scores, _ = _scored(data, names, own)
        found = met.ic_summary(met.ic_by_date(scores), min_breadth=own.min_breadth, threshold=own.ic_threshold)
        found = found.select(F.lit(arm).alias("arm"), F.lit(order).alias("arm_order"), F.lit(h).alias("horizon"), "*")
        return found.withColumn("grinold", met.grinold(F.col("rank_ic_mean"), F.col("median_breadth")))

    calls = [partial(row, order, arm, names, h) for order, (arm, names) in enumerate((arms or feat.ARMS).items()) for h in horizons]
    return reduce(DataFrame.unionByName, mod.at_once(bars.sparkSession, calls))


def settle_start(cfg: Research, horizon: int, *frames: DataFrame) -> date:
    """Earliest legal test start for a horizon: after enough bars of every symbol of every frame,
    never before the configured one."""
    least = max(cfg.test_start, cfg.train_end + timedelta(days=max(horizon, cfg.embargo)))
    for df in frames:
        least = max(least, spl.earliest_test_start(spl.calendar(df), cfg.train_end, horizon), spl.earliest_test_start_all(df, cfg.train_end, least, horizon))
    return least


def triage_candidates(rows: DataFrame, threshold: float = 0.02, horizons: tuple[int, ...] = (2, 21)) -> DataFrame:
    """Arms whose rank coefficient reaches the threshold on every one of ``horizons``; an arm without a
    row for one of them is none."""
    own = F.col("horizon").isin(*horizons)
    reached = F.coalesce(F.bool_and(F.when(own, F.coalesce(F.col("rank_ic_mean") >= threshold, F.lit(False)))), F.lit(False))
    ok = reached & (F.count_distinct(F.when(own, F.col("horizon"))) == len(set(horizons)))
    return rows.groupBy("arm").agg(ok.alias("candidate"))


def best_row(rows: DataFrame) -> DataFrame:
    """The row with the greatest rank coefficient; the first arm wins a tie."""
    return rows.orderBy(F.desc_nulls_last("rank_ic_mean"), "arm_order", "horizon").limit(1)


def breadth_verdict(rank_ic: float, reference: float = 0.0176, threshold: float = 0.02) -> str:
    if rank_ic >= threshold and rank_ic > 1.5 * reference:
        return "breadth_noise"
    flat = abs(rank_ic) < 0.005
    return "features_dead" if flat or (rank_ic < threshold and rank_ic <= reference) else "inconclusive"


@dataclass(frozen=True)
class Diagnostic:
    """Rows of coefficients, how many symbols were asked for and had bars, and the verdict."""

    rows: DataFrame
    requested: int
    kept: int
    verdict: str

    @property
    def dropped_share(self) -> float:
        return max(0, self.requested - self.kept) / self.requested


def _asked(bars: DataFrame, universe: DataFrame | None) -> tuple[int, int]:
    """(symbols of ``universe``, symbols of ``bars``); a symbol of the bars beyond the universe is an error."""
    own = bars.select("symbol").distinct()
    kept = own.count()
    if not kept:
        raise ValueError("no bars")
    if universe is None:
        return kept, kept
    if not own.join(universe.select("symbol"), "symbol", "left_anti").isEmpty():
        raise ValueError("bars of symbols beyond the universe")
    return universe.select("symbol").distinct().count(), kept


def universe_breadth(bars: DataFrame, cfg: Research, universe: DataFrame | None = None, horizon: int = 2) -> Diagnostic:
    """The baseline on a broad universe at a short horizon, told against the narrow universe's coefficient.

    ``universe`` (symbol) is what was asked for; ``cfg`` must have the horizon and the same embargo.
    """
    if (cfg.horizon, cfg.embargo) != (horizon, horizon):
        raise ValueError(f"horizon and embargo must be {horizon}")
    requested, kept = _asked(bars, universe)
    rows = run_baseline(bars, cfg).metrics.withColumn("horizon", F.lit(horizon)).cache()
    rank_ic = rows.first()["rank_ic_mean"]
    return Diagnostic(rows, requested, kept, "inconclusive" if rank_ic is None else breadth_verdict(rank_ic))


# Coefficients of the new features on the broad universe, by horizon.
BROAD_NEW = {2: 0.022127, 21: 0.034849}


def small_cap(bars: DataFrame, cfg: Research, universe: DataFrame | None = None, horizons: tuple[int, ...] = (2, 21), threshold: float = 0.02) -> Diagnostic:
    """The 15 new features on another universe, a row for each horizon beside the broad universe's coefficient."""
    if any(h not in BROAD_NEW for h in horizons):
        raise ValueError("no coefficient of the broad universe for a horizon")
    requested, kept = _asked(bars, universe)
    rows = triage(bars, cfg, horizons, {"all_new": feat.NEW})
    broad = F.create_map(*[F.lit(x) for pair in BROAD_NEW.items() for x in pair])
    rows = rows.withColumns({"above": F.coalesce(F.col("rank_ic_mean") >= threshold, F.lit(False)), "broad_rank_ic": broad[F.col("horizon")]}).cache()
    found = [r[0] for r in rows.select("rank_ic_mean").collect() if r[0] is not None]  # a row for each horizon
    return Diagnostic(rows, requested, kept, small_cap_verdict(tuple(found), threshold))


def small_cap_verdict(rank_ics: tuple[float, ...], threshold: float = 0.02) -> str:
    return "candidate" if any(x >= threshold for x in rank_ics) else "exhausted"


def momentum_verdict(rank_ics: tuple[float, ...], threshold: float = 0.02) -> str:
    """JA if the coefficient of every horizon is above the threshold."""
    return "JA" if rank_ics and all(x is not None and x > threshold for x in rank_ics) else "NEIN"


def meta_triage(bars: DataFrame, cfg: Research, names: tuple[str, ...] = feat.PRODUCTION, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Classifier on barrier events: confusion report and Sharpe of all against accepted bets."""
    events = lab.meta_events(bars)
    data = mod.assemble(feat.production_matrix(bars), events, names).persist()
    vertical = 10
    start = settle_start(cfg, vertical, bars, data)
    train, test = spl.embargo_split(data, cfg.train_end, start, vertical)
    model = mod.fit_classifier(spl.purge_barrier_ends(train, cfg.train_end), names, cfg)
    bets = mod.predict_proba(model, test, names).withColumn("predicted", (F.col("proba") >= threshold).cast("int"))
    return {
        "classification": met.classification(bets),
        "primary": met.sharpe_moments(bets, "ret"),
        "filtered": met.sharpe_moments(bets.where("predicted = 1"), "ret"),
    }


def meta_verdict(precision: float, base_rate: float, filtered: float, primary: float) -> str:
    return "JA" if precision > base_rate + 0.02 and filtered > primary else "NEIN"


def momentum_probe(bars: DataFrame, cfg: Research, horizons: tuple[int, ...] = (63, 126), test_end: date | None = None) -> DataFrame:
    """Skip-month momentum features against long forward returns."""
    matrix = feat.momentum_matrix(bars)
    names = tuple(c for c in matrix.columns if c not in ("timestamp", "symbol"))
    out = None
    for h in horizons:
        data = _dataset(bars, matrix, names, h)
        own = replace(cfg, horizon=h, embargo=h, test_start=settle_start(cfg, h, bars, data))
        data = spl.cap_test(data, test_end) if test_end else data
        _, scores, _ = _scored(data, names, own)
        row = met.ic_summary(met.ic_by_date(scores)).select(F.lit(h).alias("horizon"), "*")
        out = row if out is None else out.unionByName(row)
    return out
