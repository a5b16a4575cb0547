"""Signals of a text, and the decision they lead to: one chain of projections, no shuffle, no Python but the composer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions import text as T
from palisade.functions.patterns import any_of, is_word
from palisade.operators.fuzzy import MATCH, second_pass, second_pass_table
from palisade.operators.windows import second_pass_scan
from palisade.session import persisted, ship

_TEXT = "array<string>"
DECISION_COLUMNS = ("allow", "action", "reason", "normalized_prompt", "rewritten_prompt", "signals")


def _array(*terms: str) -> Column:
    return F.array(*map(F.lit, terms)).cast(_TEXT)


def _union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def extract(df: DataFrame, text: str, config: Config = Config(), *, compose: bool = True) -> DataFrame:
    """Add the signals of column ``text`` as columns of their own, named in ``SIGNAL_COLUMNS``.

    Which form of the text a signal reads is part of its meaning: the raw text for the allow list and ages, the
    normalised one for assertions, injections and sentence pairs, the squashed one for terms, school and clusters.
    ``heuristic_flag`` stands in for a classifier: a hard and an ambiguous term in the normalised text. Byte searches come
    before patterns, and what most texts don't need is computed for the others only.
    """
    return _by_mode(_whatever_mode(df, text, config, compose), config).drop(*_SHARED)


#: Columns of ``_whatever_mode`` that ``_by_mode`` alone reads.
_SHARED = ("_digits", "_found", "_deob_hits", "_normal_hits", "_asserted")


def _one_scan(config: Config) -> bool:
    """Whole words never overlap, so both lists can be looked for at once."""
    return all(is_word(t) for t in (*config.hard_terms, *config.ambiguous_terms))


def _whatever_mode(df: DataFrame, text: str, config: Config, compose: bool = True) -> DataFrame:
    """The forms of a text, and the signals that read the raw or the normalised one: what both modes have in common."""
    raw = F.coalesce(F.col(text), F.lit(""))
    # both forms in one projection: Spark merges all projections between two that call the composer, and would so repeat
    # the normalised text's expression wherever its column is named
    forms = {"_normal": T.normalize(raw, config, compose=compose)}
    if config.digits_before_leet:
        forms["_digits"] = T.normalize(raw, config, leet=False, compose=compose)
    df = df.withColumns(forms)
    fixed = F.when(T.may_hold_typo(F.col("_normal"), config), T.fix_typos(F.col("_normal"), config)).otherwise(F.col("_normal"))
    df = df.withColumns({"_deob": T.deobfuscate(F.col("_normal")), "normalized": fixed})
    normal = F.col("normalized")
    hard, ambiguous = config.hard_terms, config.ambiguous_terms
    if _one_scan(config):
        listed = (*hard, *ambiguous)
        df = df.withColumns({"_deob_hits": T.find_terms(F.col("_deob"), listed, True), "_normal_hits": T.find_terms(normal, listed, True)})
        flagged = (F.size(T.of_terms(F.col("_normal_hits"), hard)) > 0) & (F.size(T.of_terms(F.col("_normal_hits"), ambiguous)) > 0)
        # a whole word found in a pair of sentences stands in one of them, and so in the text
        crossed = F.when(F.size("_normal_hits") > 0, T.cross_sentence(normal, hard)).otherwise(_array())
    else:
        flagged = (F.size(T.find_terms(normal, hard)) > 0) & (F.size(T.find_terms(normal, ambiguous)) > 0)
        crossed = T.cross_sentence(normal, hard)
    return df.withColumns({
        "_asserted": T.find_terms(normal, config.adult_assertions, True),
        "ages": T.find_ages(raw, config),
        "injections": _union(T.find_terms(normal, config.injections, True), T.matches(normal, any_of(config.injection_patterns))) if config.injection_patterns else T.find_terms(normal, config.injections, True),
        "cross_sentence": crossed,
        "allowlisted": T.search(raw, config.allowlist_patterns),
        "heuristic_flag": flagged,
    })


def _by_mode(df: DataFrame, config: Config) -> DataFrame:
    """The signals that differ with spaces kept, or digits read before leetspeak."""
    normal, squashed = F.col("normalized"), F.col("_squashed")
    df = df.withColumn("_squashed", normal if config.keep_spaces else T.squash(normal))
    hard, ambiguous = config.hard_terms, config.ambiguous_terms
    if _one_scan(config):
        # with spaces kept the squashed text is the normalised one
        hits = F.col("_normal_hits") if config.keep_spaces else T.find_terms(squashed, (*hard, *ambiguous), True)
        df = df.withColumn("_found", _union(hits, F.col("_deob_hits")))
        terms = lambda some: T.of_terms(F.col("_found"), some)
    else:
        terms = lambda some: _union(T.find_terms(squashed, some), T.find_terms(F.col("_deob"), some))
    adults, school = F.col("_asserted"), T.matches(squashed, any_of(config.school_patterns))
    if config.digits_before_leet:
        adults, school = _union(adults, T.find_terms(F.col("_digits"), config.adult_assertions)), _union(school, T.matches(F.col("_digits"), any_of(config.school_patterns)))
    return df.withColumns({
        "hard_terms": terms(hard),
        "ambiguous_terms": terms(ambiguous),
        "adult_assertions": adults,
        "school_context": school,
        "cluster_score": F.when(T.may_hold(squashed, tuple(sorted({w for c in config.clusters for w in c})), True), T.cluster_score(F.split(squashed, "[\\t-\\r\\x1c-\\x20\\x85\\xa0]+"), config)).otherwise(0) if config.clusters else F.lit(0),
    })


def actions(df: DataFrame, text: str, config: Config = Config(), *, compose: bool = True) -> DataFrame:
    """Add ``action`` and ``strict_action``: how a text is decided in the compatible and in the strict mode. It is read and
    brought into its forms once for both. With spaces kept every word of a text is a window of it, so the strict side's
    fuzzy pass is a scan."""
    columns, strict = df.columns, config.strict()
    df = _whatever_mode(df, text, strict, compose)
    shared = [c for c in df.columns if c not in columns]
    df = decide(_by_mode(df, strict), strict, scanned=True).select(*columns, *shared, F.col("action").alias("strict_action"))
    return decide(_by_mode(df, config), config).select(*columns, "action", "strict_action")


SIGNAL_COLUMNS = ("normalized", "ages", "hard_terms", "ambiguous_terms", "adult_assertions", "injections", "school_context", "cross_sentence", "cluster_score", "allowlisted")


def professional_context(config: Config = Config()) -> Column:
    """Allow-listed, with a professional term and without a veto term in the normalised text."""
    normal = F.col("normalized")
    good = F.col("allowlisted") & T.contains_any(normal, config.professional_terms, config.whole_word_context) & ~T.contains_any(normal, config.veto_terms, config.whole_word_context)
    return good & ~_minor() if config.minor_age_vetoes_professional else good


def valid_adult_assertion(config: Config = Config()) -> Column:
    """No hard term, an assertion, and a guard phrase, an adult age or a costume term beside it."""
    normal = F.col("normalized")
    beside = F.exists("ages", lambda a: a >= 18) | T.contains_any(normal, config.adult_guards, config.whole_word_context) | T.contains_any(normal, config.costume_terms, config.whole_word_context)
    return (F.size("hard_terms") == 0) & (F.size("adult_assertions") > 0) & beside


def _minor() -> Column:
    return F.exists("ages", lambda a: a < 18)


def severity(config: Config = Config()) -> Column:
    """The first level one of whose terms was found; UNKNOWN else."""
    found = F.array_union("hard_terms", "ambiguous_terms")
    if config.cross_sentence_in_severity:
        found = F.array_union(found, "cross_sentence")
    level = None
    for name, terms in config.severity.items():
        hit = F.arrays_overlap(found, _array(*terms))
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return F.lit("UNKNOWN") if level is None else level.otherwise("UNKNOWN")


def _weights(config: Config) -> Column:
    if not config.ambiguous_weights:
        return F.lit(config.default_weight)
    table = F.create_map(*[F.lit(x) for pair in config.ambiguous_weights.items() for x in pair])
    return table


def context_score(config: Config = Config(), second: Column | None = None) -> Column:
    """Weighted sum of the signals, not below zero.

    With an adult age only ambiguous terms count, each with its weight less two but at least one; else hard terms count
    five each, ambiguous and pending terms their weights.
    """
    table = _weights(config)
    weight = (lambda t: F.coalesce(F.element_at(table, t), F.lit(config.default_weight))) if config.ambiguous_weights else (lambda t: F.lit(config.default_weight))
    total = lambda f: F.aggregate("ambiguous_terms", F.lit(0), lambda a, t: (a + f(weight(t))).cast("int"))
    pending = F.lit(0)
    for term in (*config.pending_hard, *config.pending_ambiguous):
        pending = pending + F.when(F.col("normalized").contains(term), config.pending_weights.get(term, config.default_weight)).otherwise(0)
    minor_side = 5 * F.size("hard_terms") + total(lambda w: w) + pending
    score = F.when(F.exists("ages", lambda a: a >= 18), total(lambda w: F.greatest(F.lit(1), w - 2))).otherwise(minor_side)
    score = score + 2 * F.size("school_context") + 6 * F.size("injections") + F.when(_minor(), 7).otherwise(0)
    score = score + (3 * F.size(second) if second is not None else 0) + 4 * F.size("cross_sentence") + F.col("cluster_score")
    score = score - F.when(valid_adult_assertion(config), 5).otherwise(0)
    score = F.when(F.col("allowlisted"), F.greatest(F.lit(0), score - config.allowlist_credit)).otherwise(score)
    return F.greatest(F.lit(0), score).cast("int")


def classified(df: DataFrame, text: str, classifier: Callable[[Column], Column], config: Config = Config(), *, name: str = "verdict") -> DataFrame:
    """Add a classifier's verdict struct<label, score> on the beginning of each text that it reads.

    ``classifier`` is any function from a column to such a column, a pandas UDF over a model for one.
    """
    return df.withColumn(name, classifier(F.substring(F.coalesce(F.col(text), F.lit("")), 1, config.model_chars)))


def model_flag(verdict: Column, config: Config = Config()) -> Column:
    """Whether a verdict is one of the flagged labels with a score above the threshold; for texts without a verdict,
    as where the classifier failed, the heuristic."""
    flagged = verdict["label"].isin(*config.model_labels) & (verdict["score"] > config.model_threshold)
    return F.coalesce(flagged, F.col("heuristic_flag"))


def decide(signals: DataFrame, config: Config = Config(), *, model: Column | None = None, joined: bool = False, scanned: bool = False) -> DataFrame:
    """Add allow, action, reason, severity, second_pass, nlp_flagged and context_score.

    Rules in order, the first that holds decides: professional context; direct violation; ambiguous context, with or
    without a valid assertion; high risk; no risk. Fields that a rule doesn't reach are null. ``model`` is a boolean
    column that replaces the heuristic, such as ``model_flag`` of a classifier's verdict. The fuzzy pass is an expression or, for texts of many
    windows, with the same rows, a scan by Arrow (``scanned``) or equality joins (``joined``, for large lexicons).
    """
    df = signals.withColumns({
        "_professional": professional_context(config),
        "_direct": (F.size("hard_terms") > 0) | (F.size("injections") > 0) | _minor(),
        "_ambiguous": (F.size("ambiguous_terms") > 0) | (F.size("school_context") > 0) | T.search(F.col("normalized"), (config.school_uniform_pattern,)) | (F.size("cross_sentence") > 0),
        "_valid": valid_adult_assertion(config),
        "_severity": severity(config),
    })
    df = df.withColumn("_late", ~F.col("_professional") & ~F.col("_direct") & ~F.col("_ambiguous"))
    if joined:
        df = persisted(df.withColumn("_digest", F.when(F.col("_late"), F.sha2(F.col("_squashed").cast("binary"), 256))))
        df = df.join(second_pass_table(df.where("_late"), "_squashed", "_digest", config), "_digest", "left").drop("_digest")
        df = df.withColumn("second_pass", F.when(F.col("_late"), F.coalesce("second_pass", F.array().cast(f"array<{MATCH}>"))))
    elif scanned:
        ship(df.sparkSession)
        df = df.withColumn("second_pass", second_pass_scan(F.when(F.col("_late"), F.col("_squashed")), config))
    else:
        df = df.withColumn("second_pass", F.when(F.col("_late"), second_pass(F.col("_squashed"), config)))
    df = df.withColumn("context_score", F.when(F.col("_late"), context_score(config, F.col("second_pass"))))
    judged = (F.col("context_score") <= config.context_threshold) & (F.size("second_pass") == 0)
    df = df.withColumn("nlp_flagged", F.when(F.col("_late"), F.coalesce(judged & (F.col("heuristic_flag") if model is None else model), F.lit(False))))
    risky = (F.col("context_score") > config.context_threshold) | (F.size("second_pass") > 0) | F.col("nlp_flagged")
    label = F.concat(F.lit(" (severity: "), F.col("_severity"), F.lit(")"))
    spelled = F.when(F.col("nlp_flagged"), "True").otherwise("False")
    reason = (
        F.when(F.col("_professional"), "Legitimate professional/educational context")
        .when(F.col("_direct"), F.concat(F.lit("Direct violation"), label))
        .when(F.col("_ambiguous") & F.col("_valid"), "Valid adult assertion with ambiguous terms")
        .when(F.col("_ambiguous"), F.concat(F.lit("Ambiguous youth context without valid adult assertion"), label))
        .when(risky, F.concat(F.lit("High risk (score: "), F.col("context_score"), F.lit(", NLP: "), spelled, F.lit(", second_pass: "), F.size("second_pass"), F.lit(")")))
        .otherwise("No minor risk detected")
    )
    allow = F.col("_professional") | ~F.col("_direct") & F.when(F.col("_ambiguous"), F.col("_valid")).otherwise(~risky)
    df = df.withColumns({"allow": allow, "reason": reason})
    df = df.withColumns({"action": F.when(F.col("allow"), "ALLOW").otherwise("BLOCK"), "severity": F.when(~F.col("allow"), F.col("_severity"))})
    return df.drop("_professional", "_direct", "_ambiguous", "_valid", "_severity", "_late")


def assess(df: DataFrame, text: str = "prompt", config: Config = Config(), *, rewrite: str | None = None, model: Column | None = None, verbose: bool = False, compose: bool = True) -> DataFrame:
    """Decisions for a table of texts: its columns, then DECISION_COLUMNS.

    ``rewrite`` names a boolean column that asks for a harmless rewriting of what is blocked. With ``verbose`` the
    squashed text is kept as ``squashed``. A null text reads as empty.
    """
    columns = df.columns
    out = decide(extract(df, text, config, compose=compose), config, model=model)
    fields = [*SIGNAL_COLUMNS, "severity", "second_pass", "nlp_flagged", "context_score"]
    signals = F.struct(*fields, F.struct(F.lit(config.model_name).alias("name"), F.lit(config.model_version).alias("version")).alias("model"))
    wanted = F.coalesce(F.col(rewrite), F.lit(False)) & ~F.col("allow") if rewrite else F.lit(False)
    rewritten = F.when(wanted, T.rewrite(F.col("normalized"), config))
    return out.select(*columns, "allow", "action", "reason", F.col("normalized").alias("normalized_prompt"), rewritten.alias("rewritten_prompt"), signals.alias("signals"), *([F.col("_squashed").alias("squashed")] if verbose else []))


def as_json(decisions: DataFrame, column: str = "json") -> DataFrame:
    """Add each decision as compact JSON, nulls included."""
    return decisions.withColumn(column, F.to_json(F.struct(*DECISION_COLUMNS), {"ignoreNullFields": "false"}))
