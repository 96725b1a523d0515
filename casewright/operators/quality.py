"""Row-level data-quality rules, compiled into one projection.

A rule is a condition with a severity, the columns it marks and a message.  All rules read the row as
it came; fills apply afterwards.  Registry membership is joined in once, before the projection.  What several
rules share (the parsed task map) and the issues themselves are each computed once per row, behind a generator
that the optimizer does not inline into every place of use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.timeutil import minutes, sheet_date
from casewright.operators.known_ids import gram_index, met_ids
from casewright.operators.similar import nearest

ERROR, WARNING = "E", "W"


@dataclass(frozen=True)
class Rule:
    id: str
    columns: tuple[str, ...]
    severity: str
    condition: Column
    message: Column | str = ""
    values: Column | None = None  # the offending values, for which a suggestion is sought
    each: Column | None = None  # messages, an issue for every one of them


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each evaluated once per row however often it is read."""
    held = df.withColumn("#once", F.explode_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return held.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(f"`#once`.`{n}`") for n in columns))


def _issue(rule: Rule, column: str, ordinal: int, message: Column) -> Column:
    return F.struct(
        F.lit(rule.id).alias("rule"), F.lit(column).alias("column"), F.lit(rule.severity).alias("severity"),
        F.lit(ordinal).alias("ordinal"), message.alias("message"),
        (F.lit(None).cast("array<string>") if rule.values is None else rule.values).alias("values"),
    )


def compile_rules(rules: list[Rule]) -> Column:
    """One array of (rule, column, severity, ordinal, message) structs per row."""
    runs: list[Column] = []
    cells: list[Column] = []
    for ordinal, rule in enumerate(rules):
        for column in rule.columns:
            if rule.each is None:
                message = F.lit(rule.message) if isinstance(rule.message, str) else rule.message
                cells.append(F.when(rule.condition, _issue(rule, column, ordinal, message)))
                continue
            runs += [F.array(*cells)] if cells else []
            runs.append(F.transform(F.when(rule.condition, rule.each).otherwise(F.array().cast("array<string>")), lambda m: _issue(rule, column, ordinal, m)))
            cells = []
    runs += [F.array(*cells)] if cells else []
    return F.array_compact(runs[0] if len(runs) == 1 else F.concat(*runs))


def with_issues(sheet: DataFrame, rules: list[Rule]) -> DataFrame:
    return once(sheet, issues=compile_rules(rules))


def issues_long(judged: DataFrame) -> DataFrame:
    """One row per issue.  (``explode`` would repeat the array's expression in a filter before it.)"""
    return judged.select("row_id", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("row_id", "i.*")


def with_suggestions(issues: DataFrame, known: list[str] | DataFrame, cutoff: float = 0.6, keep=None) -> DataFrame:
    """Issues with offending values, one row per value, with the closest of ``known`` (or null) and the message that
    asks for it.  Only distinct values are compared.  ``known`` is a registry's frame with a column NAME, of any size, or
    a short list of names.  ``keep(df, name)`` may write the distinct values and read them back, so that the issues are
    not worked out for every step that reads them."""
    given = issues.where(F.size("values") > 0).select("*", F.explode("values").alias("value")).drop("values")
    if isinstance(known, DataFrame):
        values = (keep or (lambda df, _: df))(given.select("value", F.upper("value").alias("upper")).distinct(), "offending")
        found = nearest(values.select(F.col("upper").alias("value")), known.select(F.upper("NAME").alias("name")), cutoff, keep)
        close = values.join(found.select(F.col("value").alias("upper"), F.col("name").alias("suggestion")), "upper").select("value", "suggestion")
    else:
        close = given.select("value").distinct().withColumn("suggestion", X.close_match([k.upper() for k in known], cutoff)(F.upper("value")))
    asked = F.when(F.col("suggestion").isNotNull(), F.concat("message", F.lit("; did you mean "), "suggestion", F.lit("?"))).otherwise(F.col("message"))
    return given.join(close, "value", "left").withColumn("message", asked)


def _has(severity: str, column: str | None = None) -> Column:
    test = lambda i: (i["severity"] == severity) & (F.lit(True) if column is None else i["column"] == column)
    return F.exists("issues", test)


def summary_matrix(judged: DataFrame, columns: list[str], legacy_summary: bool = False) -> DataFrame:
    """Per row and column '', 'W', 'E' or 'EW'; with ``legacy_summary`` an error hides the warning."""

    marks = once(judged.select("row_id", "issues"), marks=F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["column"])))

    def cell(column: str) -> Column:
        e, w = (F.array_contains("marks", f"{severity}:{column}") for severity in (ERROR, WARNING))
        both = F.lit("E" if legacy_summary else "EW")
        return F.when(e & w, both).when(e, "E").when(w, "W").otherwise("").alias(column)

    return marks.select("row_id", *map(cell, columns))


def roll_up(judged: DataFrame) -> DataFrame:
    """Per row its errors and warnings; the sheet's row number counts the header and starts at one."""
    of = lambda s: F.transform(F.filter("issues", lambda i: i["severity"] == s), lambda i: F.concat_ws(":", i["rule"], i["column"]))
    return judged.select("row_id", (F.col("row_id") + 2).alias("sheet_row"), of(ERROR).alias("errors"), of(WARNING).alias("warnings"))


def totals(judged: DataFrame) -> DataFrame:
    """Sheet totals and the permission to go on: no error anywhere."""
    size = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    counted = once(judged.select("issues"), e=size(ERROR), w=size(WARNING))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    errors = zero(F.sum("e"))
    return counted.agg(
        F.count("*").alias("n_rows"), errors.alias("n_errors"), zero(F.sum("w")).alias("n_warnings"),
        F.count_if(F.col("e") > 0).alias("rows_with_errors"), F.count_if(F.col("w") > 0).alias("rows_with_warnings"),
        (errors == 0).alias("permitted"),
    )


def rows_where(judged: DataFrame, mode: str) -> DataFrame:
    """Rows with errors, warnings, both or any kind of issue."""
    tests = {"errors": _has(ERROR), "warnings": _has(WARNING), "both": _has(ERROR) & _has(WARNING), "any": _has(ERROR) | _has(WARNING), "all": F.lit(True)}
    if mode not in tests:
        raise ValueError(f"unknown mode {mode!r}")
    return judged.where(tests[mode])


FREE_TEXT = ("unusual", "diagnostic", "comments")
ENCODED_TEXT = (*FREE_TEXT, "assessment_details")


def join_registries(sheet: DataFrame, users: DataFrame, sites: DataFrame, groups: DataFrame, surgeons: DataFrame) -> DataFrame:
    """Membership flags ``ok_<column>``; the performing surgeon also by exact spelling."""
    from casewright.operators.registry import member_flag

    for column, registry, exact in (
        ("filer", users, False), ("institution", sites, False), ("procedure", groups, False), ("supervising", surgeons, False),
        ("performing", surgeons, False), ("performing", surgeons, True), ("assessor", surgeons, False),
    ):
        sheet = member_flag(sheet, column, registry, f"{'exact' if exact else 'ok'}_{column}", ignore_case=not exact)
    return sheet


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its scan has fewer splits than there are; rules cost more than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_task_facts(sheet: DataFrame) -> DataFrame:
    """The task map's keys (null where it cannot be read) and notices, parsed once for all rules."""
    return once(sheet, task_keys=X.task_keys(F.col("tasks")), task_notices=X.task_notices(F.col("tasks")))


def with_registry_facts(sheet: DataFrame, ids: DataFrame, surgeons: DataFrame, keep=None) -> DataFrame:
    """What the rules ask of registries of any size, found by joins over distinct texts: ``ids_<column>``, the known ids
    that a free text holds, in the order of ``ids(id, uid, place)``, and ``unknown_keys``, the task-map keys that
    ``surgeons(NAME)`` lacks in any case.  The plan does not depend on how many names there are.

    ``keep(df, name)`` may write a result and read it back, since texts and index are read more than once.
    """
    keep = keep or (lambda df, _: df)
    texts = keep(sheet.select(F.explode(F.array(*ENCODED_TEXT)).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != "")).distinct(), "texts")
    index = keep(gram_index(ids), "index")
    sizes = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # a few lengths
    met = met_ids(texts.select(F.col("text").alias("row_key"), "text"), index, sizes)
    found = keep(met.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("f")).select("row_key", F.transform("f", lambda e: e["id"]).alias("f")), "found")
    for column in ENCODED_TEXT:
        own = found.select(F.col("row_key").alias("#text"), F.col("f").alias(f"ids_{column}"))
        sheet = sheet.join(own, F.col(column) == F.col("#text"), "left").drop("#text").withColumn(f"ids_{column}", F.coalesce(f"ids_{column}", F.array().cast("array<string>")))
    names = surgeons.select(F.lower("NAME").alias("key")).distinct()
    keys = sheet.select("tasks", F.posexplode("task_keys").alias("at", "key")).distinct()
    unknown = keys.join(names, "key", "left_anti").groupBy("tasks").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("f"))
    return sheet.join(unknown.select(F.col("tasks").alias("#tasks"), F.transform("f", lambda e: e["key"]).alias("unknown_keys")), F.col("tasks") == F.col("#tasks"), "left").drop("#tasks")


def sheet_rules(ids: list[tuple[str, str]] = (), surgeon_names: Column | None = None, legacy: bool = False, joined: bool = False) -> list[Rule]:
    """The batch-sheet rules over columns flagged by ``join_registries`` and ``with_task_facts``; with ``joined`` also by
    ``with_registry_facts``, instead of ``ids`` and ``surgeon_names``.

    A task map that cannot be read ends a row: the rules after it do not fire.

    ``ids`` are the identifiers sought in free text; ``surgeon_names`` an array column of known lower-cased
    surgeons for the task-map keys.  ``legacy`` keeps the second, duplicate warning for blank surgeons.
    """
    col, empty = F.col, lambda c: X.is_empty(F.col(c))
    unknown = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) == "unknown"
    tasks = ~empty("tasks")
    keys = col("task_keys")
    broken = tasks & keys.isNull()
    parsed = tasks & keys.isNotNull()
    count = col("n_surgeons").try_cast("int")
    size_fits = F.coalesce(F.size(keys) == count, F.lit(False))
    key_of = lambda c: F.array_contains(keys, F.lower(F.col(c)))
    requested = ~broken & ~empty("skills_requested") & ~unknown("skills_requested")
    value = lambda c: F.array(F.col(c))
    surgeons = surgeon_names if surgeon_names is not None else F.array().cast("array<string>")
    strange = F.coalesce("unknown_keys", F.array().cast("array<string>")) if joined else F.filter(keys, lambda k: ~F.array_contains(surgeons, k))
    start, end = minutes(col("start_time")), minutes(col("end_time"))
    rules = [
        Rule("R-01", ("filer",), ERROR, empty("filer") | ~col("ok_filer"), "filer missing or not registered"),
        Rule("R-02", ("operation_date",), WARNING, ~empty("operation_date") & (sheet_date(col("operation_date")) < F.lit("2000-01-01").cast("date")), "operation date before 2000"),
        Rule("R-03", ("start_time",), ERROR, empty("start_time"), "start time missing"),
        Rule("R-04", ("institution",), ERROR, empty("institution") | ~col("ok_institution"), "institution missing or not registered"),
        Rule("R-05", ("procedure",), ERROR, empty("procedure") | ~col("ok_procedure"), "procedure missing or not registered"),
        Rule("R-06", ("path",), ERROR, empty("path") | ~F.coalesce(col("path_exists"), F.lit(True)), "path missing"),
        Rule("R-07", ("quality",), WARNING, empty("quality"), "quality taken as unknown"),
        Rule("R-08", ("supervising",), WARNING, empty("supervising"), "supervising surgeon taken as unknown"),
        Rule("R-08", ("supervising",), ERROR, ~empty("supervising") & ~col("ok_supervising"), "supervising surgeon not registered"),
        Rule("R-09", ("performing",), WARNING, empty("performing"), "performing surgeon taken as unknown"),
        Rule("R-09", ("performing",), ERROR, ~empty("performing") & ~col("exact_performing"), "performing surgeon not registered"),
    ]
    unencoded = lambda c: F.transform(f"ids_{c}", lambda i: F.concat(i, F.lit(" stands unencoded")))
    for column in FREE_TEXT:
        if joined:
            rules.append(Rule("R-10", (column,), WARNING, F.lit(True), each=unencoded(column)))
        for known, _ in ids:
            rules.append(Rule("R-10", (column,), WARNING, F.contains(F.col(column), F.lit(known)), F.concat(F.lit(known), F.lit(" stands unencoded"))))
    rules += [
        Rule("R-11", ("skills_requested",), WARNING, empty("skills_requested"), "skills request taken as unknown"),
        Rule("R-12", ("radiology_contacted",), WARNING, empty("radiology_contacted"), "radiology contact taken as unknown"),
        Rule("R-13", ("end_time",), ERROR, ~empty("end_time") & ~unknown("end_time") & (end < start), "end before start"),
        Rule("R-14", ("supervising",), ERROR, ~empty("supervising") & ~unknown("performing") & ~col("ok_supervising"), "supervising surgeon not registered", value("supervising")),
        Rule("R-15", ("performing",), ERROR, ~empty("performing") & ~unknown("performing") & ~col("ok_performing"), "performing surgeon not registered", value("performing")),
        Rule("R-15", ("performing", "tasks"), ERROR, unknown("performing") & tasks, "tasks without a performing surgeon"),
        Rule("R-16", ("n_surgeons", "tasks"), ERROR, empty("n_surgeons") & tasks & ~unknown("performing"), "tasks without a number of surgeons"),
    ]
    for notice in ("braces", "shape", "colons"):
        rules.append(Rule("R-17", ("tasks",), WARNING, tasks & F.array_contains("task_notices", notice), f"task map: {notice}"))
    rules += [
        Rule("R-17", ("tasks",), ERROR, broken, "task map cannot be read"),
        Rule("R-18", ("tasks",), ERROR, parsed & (unknown("performing") | ~F.coalesce(key_of("performing"), F.lit(False))), "performing surgeon has no task"),
        Rule("R-19", ("tasks",), ERROR, parsed & ~size_fits, "number of surgeons and tasks differ"),
        Rule("R-20", ("tasks",), ERROR, parsed & size_fits & (F.size(strange) > 0), "task of an unregistered surgeon", strange),
        Rule("R-22", ("n_surgeons", "tasks"), ERROR, ~tasks & ~empty("n_surgeons") & (F.coalesce(count, F.lit(0)) != 1), "several surgeons without tasks"),
        Rule("R-23", ("tasks",), ERROR, parsed & ~empty("performing") & ~F.lower(col("performing")).isin("unknown", "not-applicable") & ~key_of("performing"), "performing surgeon not among the tasks"),
        Rule("R-24", ("tasks",), WARNING, parsed & ~empty("supervising") & ~F.lower(col("supervising")).isin("unknown", "not-applicable") & ~key_of("supervising"), "supervising surgeon not among the tasks"),
        Rule("R-25", ("assessor",), WARNING, requested & empty("assessor"), "assessor taken as unknown"),
        Rule("R-25", ("assessor",), ERROR, requested & ~empty("assessor") & ~col("ok_assessor"), "assessor not registered", value("assessor")),
        Rule("R-26", ("skills_requested",), ERROR, requested & ~empty("assessor") & (F.lower(col("skills_requested")) != "y"), "assessor without a request"),
    ]
    if joined:
        rules.append(Rule("R-27", ("assessment_details",), WARNING, requested, each=unencoded("assessment_details")))
    for known, _ in ids:
        rules.append(Rule("R-27", ("assessment_details",), WARNING, requested & F.contains(col("assessment_details"), F.lit(known)), F.concat(F.lit(known), F.lit(" stands unencoded"))))
    rules.append(Rule("R-28", ("radiology_date",), WARNING, ~broken & (F.lower(col("radiology_contacted")) == "y") & empty("radiology_date"), "radiology date missing"))
    if legacy:
        rules += [
            Rule("R-14", ("supervising",), WARNING, empty("supervising"), "supervising surgeon taken as unknown"),
            Rule("R-15", ("performing",), WARNING, empty("performing"), "performing surgeon taken as unknown"),
        ]
    return rules


#: Columns whose blanks become 'unknown' after the rules have run.
FILLED = ("quality", "supervising", "performing", "skills_requested", "radiology_contacted", "assessor")


def fill_blanks(sheet: DataFrame, columns: tuple[str, ...] = FILLED) -> DataFrame:
    return sheet.withColumns({c: F.when(X.is_empty(F.col(c)), "unknown").otherwise(F.col(c)) for c in columns})


#: The domains of the form's closed questions and the shape of its task map.
QUALITIES = ("usable", "unusable", "questionable", "unknown", "")
SIDES = ("RIGHT", "LEFT", "BOTH", "UNKNOWN")
PRESENCES = ("PRESENT", "RETROSPECTIVE_REVIEW", "OTHER-SEE_ADDITIONAL_COMMENTS")
FORM_TASKS = r"^\{(?:\s*([a-zA-Z0-9_]+)\s*:\s*([^,{}]+)\s*,)*\s*([a-zA-Z0-9_]+)\s*:\s*([^,{}]+)\s*\}$"
FORM_PAIR = r"([a-zA-Z0-9_]+)\s*:\s*([^,{}]+)"


def join_form_registries(sheet: DataFrame, users: DataFrame, sites: DataFrame, groups: DataFrame, surgeons: DataFrame) -> DataFrame:
    """Membership flags of the form: filer, institution and procedure as spelled, surgeons in any case."""
    from casewright.operators.registry import member_flag

    for column, registry, exact in (("filer", users, True), ("institution", sites, True), ("procedure", groups, True), ("supervising", surgeons, False), ("performing", surgeons, False)):
        sheet = member_flag(sheet, column, registry, f"form_{column}", ignore_case=not exact)
    return once(sheet, form_keys=F.array_distinct(F.regexp_extract_all(F.coalesce("tasks", F.lit("")), F.lit(FORM_PAIR), F.lit(1))))


def form_checks(surgeon_names: Column | None = None) -> list[Rule]:
    """The second rule set: what a sheet row must fulfil to become a form.

    It reads the flags of ``join_form_registries``; ``surgeon_names`` is an array column of the registered names.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.col(c).try_cast("int")
    surgeons = surgeon_names if surgeon_names is not None else F.array().cast("array<string>")
    keys = F.col("form_keys")
    return [
        Rule("S-01", ("filer",), ERROR, ~F.col("form_filer"), "filer not registered"),
        Rule("S-02", ("operation_date",), ERROR, text("operation_date") == "", "date missing"),
        Rule("S-03", ("operation_date",), ERROR, (text("operation_date") != "") & ~text("operation_date").rlike(r"^\d{4}-\d{2}-\d{2}"), "date not as YYYY-MM-DD"),
        Rule("S-04", ("quality",), ERROR, ~F.lower(text("quality")).isin(*QUALITIES), "quality"),
        Rule("S-05", ("institution",), ERROR, ~F.col("form_institution"), "institution not registered"),
        Rule("S-06", ("procedure", "procedure_type"), ERROR, ~F.col("form_procedure"), "procedure not registered"),
        Rule("S-07", ("start_time",), ERROR, text("start_time") == "", "start time missing"),
        Rule("S-08", ("end_time",), ERROR, (text("end_time") != "") & (text("end_time") < text("start_time")), "end before start"),
        Rule("S-09", ("side",), ERROR, ~F.upper(text("side")).isin(*SIDES), "side"),
        Rule("S-10", ("supervising",), ERROR, ~F.col("form_supervising"), "supervising surgeon not registered"),
        Rule("S-11", ("presence",), ERROR, ~F.upper(text("presence")).isin(*PRESENCES), "presence of the supervising surgeon"),
        Rule("S-12", ("performing",), ERROR, ~F.col("form_performing"), "performing surgeon not registered"),
        Rule("S-13", ("years",), ERROR, ~F.coalesce(number("years") > 0, F.lit(False)), "years of experience"),
        Rule("S-14", ("prior_cases",), ERROR, ~F.coalesce(number("prior_cases") >= 0, F.lit(False)), "prior cases"),
        Rule("S-15", ("n_surgeons",), ERROR, ~F.coalesce(number("n_surgeons") >= 0, F.lit(False)), "number of surgeons"),
        Rule("S-16", ("tasks",), ERROR, ~text("tasks").rlike(FORM_TASKS), "task map not as {id: task}"),
        Rule("S-17", ("tasks",), ERROR, F.exists(keys, lambda k: ~F.array_contains(surgeons, k)), "task of an unregistered surgeon"),
        Rule("S-18", ("tasks",), ERROR, ~F.coalesce(F.size(keys) == number("n_surgeons"), F.lit(False)), "number of surgeons and tasks differ"),
    ]


#: The ranges of the prompts' numbers.
PROMPT_RANGES = {"years": (1, 50), "prior_cases": (0, 500), "n_surgeons": (1, 1000)}


def in_prompt_range(column: str) -> Column:
    """Whether a prompt's answer is a whole number within its range."""
    low, high = PROMPT_RANGES[column]
    return F.coalesce(F.col(column).try_cast("int").between(low, high), F.lit(False))
