"""Explainable rules as CASE columns: every refusal names its reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import staleness

#: Edge statuses by rank, floors by market, trusted ways of name resolution.
EDGE_RANK = {"ABAIXO_DO_LIMITE": 0, "ATINGE_EDGE_2": 1, "ATINGE_EDGE_3": 2, "ATINGE_EDGE_5": 3, "ATINGE_EDGE_7_5": 4, "ATINGE_EDGE_10": 5}
MARKET_FLOOR = {"aces_player": "ATINGE_EDGE_3", "total_aces_match": "ATINGE_EDGE_2", "double_faults_player": "ATINGE_EDGE_5"}
RELIABLE = ("exact", "alias")
MIN_ODDS, STRONG_RANK = 1.30, 4


def yes(c: Column) -> Column:
    """A nullable condition as a filter: NULL is no."""
    return F.coalesce(c, F.lit(False))


def _reasons(tests: Sequence[tuple[Column | str, Column]]) -> Column:
    """Names or texts of the tests that fail."""
    marks = [F.when(~yes(ok), F.lit(text) if isinstance(text, str) else text) for text, ok in tests]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def sample_quality(matches: Column, service: Column, returns: Column, surface: Column, consistent: Column) -> Column:
    known = matches.isNotNull() & service.isNotNull() & returns.isNotNull() & surface.isNotNull() & yes(consistent)
    high = (matches >= 50) & (service >= 300) & (returns >= 300) & (surface >= 10)
    medium = (matches >= 10) & (service >= 60) & (returns >= 60)
    return F.when(~known, "LOW").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def flag_candidates(df: DataFrame, buckets: Sequence[str] = ("medium_10_49", "large_50_plus")) -> DataFrame:
    """is_candidate and candidate_blockers, from five named predicates."""
    tests = [
        ("historico_suficiente", F.col("sample_bucket_career").isin(*buckets)),
        ("mercado_liberado", ~F.col("restricted")),
        ("calibracao_disponivel", F.col("method_selected") != "unavailable"),
        ("probabilidade_nao_trivial", ~F.col("extreme_probability")),
        ("identidade_confiavel", F.col("resolution_method_player").isin(*RELIABLE) & F.col("resolution_method_opponent").isin(*RELIABLE)),
    ]
    failed = _reasons(tests)
    return df.select("*", (F.size(failed) == 0).alias("is_candidate"), F.array_join(failed, ",").alias("candidate_blockers"))


def decision_state(is_candidate: Column, blockers: Column) -> Column:
    """CONFERIR_ODDS; OBSERVAR if a trivial probability is the only blocker; DESCARTADO."""
    return F.when(yes(is_candidate), "CONFERIR_ODDS").when(blockers == "probabilidade_nao_trivial", "OBSERVAR").otherwise("DESCARTADO")


def evaluate_opportunities(df: DataFrame, floors: dict[str, str] | None = None) -> DataFrame:
    """classification, reasons, alerts, sample_quality, staleness_bucket and capped.

    All gates must hold, else DESCARTAR with every failing gate. Then a ladder by edge rank
    against the market's floor and by sample quality; stale data caps the strongest state.
    """
    floors = floors or MARKET_FLOOR
    c = F.col
    consistent = ~(yes(c("cold_start")) | yes(c("insufficient_history")) | yes(c("calibrator_insufficient_sample")))
    quality = sample_quality(c("prior_matches_career"), c("prior_service_points_career"), c("prior_return_points_career"), c("surface_prior_matches"), consistent)
    days = c("data_staleness_days")
    bucket = staleness(days)
    matched = yes(c("matched"))
    text = lambda x, other: F.coalesce(x, F.lit(other))
    gates = [
        (F.concat(F.lit("mercado_aprovado: "), text(c("market"), "?")), c("market").isin(*MARKET_FLOOR)),
        (F.concat(F.lit("linha_existe_na_distribuicao: "), text(c("match_reason"), "motivo nao registrado")), matched),
        (F.concat(F.lit("previsao_nao_restrita: "), text(c("restricted_motivo"), "restricao herdada")), ~yes(c("restricted"))),
        ("identidade_confiavel", matched & c("resolution_method_player").isin(*RELIABLE) & c("resolution_method_opponent").isin(*RELIABLE)),
        ("probabilidade_operacional_valida", matched & (c("operational_probability") > 0) & (c("operational_probability") < 1)),
        ("odd_acima_do_limite_configurado", c("decimal_odds") >= MIN_ODDS),
        (F.concat(F.lit("amostra_historica_minima: "), quality), quality != "LOW"),
        ("staleness_registrada", c("historical_data_cutoff").isNotNull() & days.isNotNull()),
    ]
    failed = _reasons(gates)
    ranks = F.create_map(*[F.lit(x) for item in EDGE_RANK.items() for x in item])
    floor_map = F.create_map(*[F.lit(x) for k, v in floors.items() for x in (k, EDGE_RANK[v])])
    rank, floor = F.coalesce(F.try_element_at(ranks, c("status")), F.lit(0)), F.coalesce(F.try_element_at(floor_map, c("market")), F.lit(EDGE_RANK["ATINGE_EDGE_5"]))
    high = quality == "HIGH"
    ladder = (
        F.when(rank < floor, "OBSERVAR")
        .when(rank == floor, "CANDIDATO_FRACO")
        .when(rank < STRONG_RANK, F.when(high, "CANDIDATO").otherwise("CANDIDATO_FRACO"))
        .otherwise(F.when(high, "CANDIDATO_FORTE").otherwise("CANDIDATO"))
    )
    passed = F.size(failed) == 0
    capped = passed & (ladder == "CANDIDATO_FORTE") & (bucket == "MUITO_DEFASADO")
    why = F.filter(
        F.array(
            F.when(c("model_edge").isNotNull(), F.format_string("edge = %+.1f p.p.", c("model_edge") * 100)).otherwise("edge = N/A"),
            F.concat(F.lit("amostra = "), quality),
            F.when(yes(c("method_selected") != "unavailable"), "calibração aprovada").otherwise("calibração indisponível"),
            F.when(c("surface_ctx") != "", F.concat(F.lower("surface_ctx"), F.lit(" court"))),
        ),
        lambda x: x.isNotNull(),
    )
    late = F.concat(F.lit("defasagem de "), days.cast("string"), F.lit(" dias"))
    alerts = F.filter(
        F.array(
            F.when(capped, F.concat(F.lit("CANDIDATO_FORTE bloqueado por staleness: "), late)),
            F.when((bucket != "ATUAL") & (passed | days.isNotNull()), late),
            F.when(passed & yes(c("extreme_probability")), "probabilidade extrema (>=90%)"),
        ),
        lambda x: x.isNotNull(),
    )
    state = F.when(~passed, "DESCARTAR").when(capped, "CANDIDATO").otherwise(ladder)
    return df.select("*", state.alias("classification"), F.when(passed, why).otherwise(failed).alias("reasons"), alerts.alias("alerts"), quality.alias("sample_quality"), bucket.alias("staleness_bucket"), capped.alias("capped"))


def explanation(classification: Column, reasons: Column, alerts: Column) -> Column:
    """The state, its reasons and alerts as lines."""
    listed = lambda title, items: F.concat(F.lit(f"\n\n{title}:\n- "), F.array_join(items, "\n- "))
    return F.concat(classification, listed("Motivos", reasons), F.when(F.size(alerts) > 0, listed("Alertas", alerts)).otherwise(""))


def sensitivity(df: DataFrame, by: Sequence[str], uniform: str = "ATINGE_EDGE_5") -> DataFrame:
    """How many classifications change under one floor for all markets."""
    base = evaluate_opportunities(df).withColumnRenamed("classification", "_before").drop("reasons", "alerts", "sample_quality", "staleness_bucket", "capped")
    both = evaluate_opportunities(base, {m: uniform for m in MARKET_FLOOR})
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before") != F.col("classification")).alias("n_changed"))


def classify_market(wins: Column, folds: Column, gain: Column, strong: Column, covered: Column, flagged: Column, least_gain: float = 0.03) -> Column:
    """PAUSAR, EXPERIMENTAL or CANDIDATO from wins over folds."""
    return (
        F.when(~yes(covered), "PAUSAR")
        .when((wins <= 1) | (gain <= 0), "PAUSAR")
        .when((wins == folds) & (strong == folds) & (gain >= least_gain) & ~yes(flagged), "CANDIDATO")
        .otherwise("EXPERIMENTAL")
    )


def select_method(df: DataFrame, group: Sequence[str], method: str = "method", fold: str = "fold", least: float = 0.01) -> DataFrame:
    """Per group the method that gains ``least`` of Brier and doesn't worsen ECE in every fold, else raw."""
    raw = df.filter(F.col(method) == "raw").select(*group, fold, F.col("brier").alias("_b"), F.col("ece").alias("_e"))
    gain = (F.col("_b") - F.col("brier")) / F.col("_b")
    tried = df.filter(F.col(method) != "raw").join(raw, [*group, fold]).groupBy(*group, method).agg(F.bool_and((gain >= least) & (F.col("ece") <= F.col("_e"))).alias("ok"), F.avg(gain).alias("gain"))
    nth = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("gain"), method))
    best = tried.filter("ok").withColumn("_nth", nth).filter("_nth = 1").select(*group, F.col(method).alias("_best"))
    return df.select(*group).distinct().join(best, list(group), "left").select(*group, F.coalesce("_best", F.lit("raw")).alias("method_selected"))


def settle(status: Column, line: Column, actual: Column, side: Column) -> Column:
    """WIN, LOSS, VOID; BOOKMAKER_RULE_REQUIRED for matches cut short; UNRESOLVED without a result."""
    over = F.lower(side) == "over"
    return (
        F.when(status.isNull() | (actual.isNull() & (status == "completed")), "UNRESOLVED")
        .when(status.isin("retirement", "walkover"), "BOOKMAKER_RULE_REQUIRED")
        .when(actual == line, "VOID")
        .when(over == (actual > line), "WIN")
        .otherwise("LOSS")
    )


def validate_entries(df: DataFrame, tours: Sequence[str], markets: Sequence[str]) -> DataFrame:
    """``errors``: everything wrong with an observed price entry."""
    c = F.col
    tests = [
        ("tour", c("tour").isin(*tours)),
        ("market", c("market").isin(*markets)),
        ("player", F.trim("player") != ""),
        ("line", c("line").isNotNull()),
        ("side", c("over_odds").isNotNull() | c("under_odds").isNotNull()),
        ("over_odds", c("over_odds").isNull() | (c("over_odds") > 1)),
        ("under_odds", c("under_odds").isNull() | (c("under_odds") > 1)),
    ]
    return df.withColumn("errors", _reasons(tests))


def entry_sides(df: DataFrame) -> DataFrame:
    """A row per priced side of an entry."""
    sides = F.filter(F.array(F.struct(F.lit("over").alias("side"), F.col("over_odds").alias("decimal_odds")), F.struct(F.lit("under").alias("side"), F.col("under_odds").alias("decimal_odds"))), lambda s: s["decimal_odds"].isNotNull())
    return df.select("*", F.explode(sides).alias("_s")).select("*", "_s.*").drop("_s", "over_odds", "under_odds")


def validate_readings(df: DataFrame, upload: str, position: str, market: str, player: str, display: str, odds: str, known: Sequence[str] | None = None) -> DataFrame:
    """Readings with line, side, ``warnings`` (never dropped) and ``needs_confirmation``."""
    from ..functions.text import line_and_side

    ls = line_and_side(F.col(market), F.col(display))
    df = df.select("*", ls["line"].alias("model_line"), ls["side"].alias("side"))
    group = W.partitionBy(upload, market, player).orderBy(position)
    same = F.count(F.lit(1)).over(W.partitionBy(upload, market, player, "model_line", "side"))
    pair = F.count(F.lit(1)).over(W.partitionBy(upload, market, player, "model_line"))
    falls = F.coalesce(F.col("model_line") <= F.lag("model_line").over(group), F.lit(False))
    cheaper = F.coalesce((F.col("model_line") > F.lag("model_line").over(group)) & (F.col(odds) < F.lag(odds).over(group)), F.lit(False))
    total = F.col(market).contains("total_games")
    tests = [
        ("format", F.col("model_line").isNotNull()),
        ("odds", F.col(odds) > 1),
        ("player", F.lit(True) if known is None else (F.col(player).isin(*known) | total)),
        ("duplicate", same == 1),
        ("line_order", total | ~falls),
        ("odds_order", total | ~cheaper),
        ("incomplete_pair", ~total | (pair == 2)),
    ]
    df = df.withColumn("warnings", _reasons(tests))
    return df.withColumn("needs_confirmation", F.size("warnings") > 0)


def structural_error(warnings: Column) -> Column:
    """Whether a reading's warnings bar its confirmation."""
    return F.arrays_overlap(warnings, F.array(F.lit("format"), F.lit("odds")))


def reading_status(df: DataFrame, upload: str) -> DataFrame:
    """Per upload: INVALID, NEEDS_REVIEW or READY, by its worst reading."""
    return df.groupBy(upload).agg(F.when(F.bool_or(structural_error(F.col("warnings"))), "INVALID").when(F.bool_or("needs_confirmation"), "NEEDS_REVIEW").otherwise("READY").alias("upload_status"))


def screenshot_label(classification: Column, matched: Column) -> Column:
    """PASSOU, OBSERVAR, NAO_PASSOU, or SEM_AVALIACAO where there was no line to compare."""
    return F.when(~yes(matched), "SEM_AVALIACAO").when(classification.startswith("CANDIDATO"), "PASSOU").when(classification == "OBSERVAR", "OBSERVAR").otherwise("NAO_PASSOU")


def confirm_readings(raw: DataFrame, edited: DataFrame, upload: str, fields: Sequence[str]) -> DataFrame:
    """Per upload: CONFIRMED, or BLOCKED by an edited reading with a structural error, and whether
    the edited readings are ``corrected``, other than the raw ones whatever their order."""
    listed = lambda df, name: df.groupBy(upload).agg(F.collect_list(F.struct(*fields)).alias(name))
    bad = edited.groupBy(upload).agg(F.bool_or(structural_error(F.col("warnings"))).alias("bad"))
    both = listed(edited, "confirmed").join(listed(raw, "raw"), upload, "left").join(bad, upload)
    from .selection import confirmed_changes

    return both.select(upload, F.when(F.col("bad"), "BLOCKED").otherwise("CONFIRMED").alias("confirmation"), F.when(~F.col("bad"), confirmed_changes(F.coalesce("raw", F.expr("slice(confirmed, 1, 0)")), F.col("confirmed"))).alias("corrected"))


def evaluate_confirmed(readings: DataFrame, prices: DataFrame, context: DataFrame, group: Sequence[str], player: str = "player") -> DataFrame:
    """Confirmed readings against the model's lines: matched, evaluated by all rules, and labelled.

    ``prices`` are priced lines and ``context`` the columns the rules need of each match.
    """
    from .joins import enrich, match_lines

    matched = match_lines(readings, prices, group, name=player)
    rows = enrich(matched, [(context, ["matched_id"], "")])
    out = evaluate_opportunities(rows)
    return out.withColumn("label", screenshot_label(F.col("classification"), F.col("matched")))


def http_status(code: Column) -> Column:
    return F.when(code.isNull(), "unavailable").when(code < 400, "adequate").when(code.isin(401, 403, 429), "blocked").otherwise("unavailable")


def schema_adequacy(header: Column, required: Sequence[str]) -> Column:
    """Struct missing, adequate of a comma-joined header line."""
    have = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.trim(x))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), have)
    return F.struct(missing.alias("missing"), F.when(header.isNull(), "unavailable").when(F.size(missing) == 0, "adequate").otherwise("inadequate_schema").alias("status"))
