"""Persona-side text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories whose numbers are money
MONEY_CATEGORIES = ["income", "assets", "wealth", "debt", "savings", "net_worth"]
MONEY_TOKENS = ["income", "asset", "wealth", "debt", "saving", "net worth", "property", "rent", "mortgage", "cost"]
METRIC_SUFFIXES = ["mean", "std", "median", "mode"]


def split_metric_names(profiles: DataFrame, id_col: str = "cluster_id") -> DataFrame:
    """``X_mean / _std / _median / _mode`` columns -> long
    ``(cluster_id, field, metric, value, ord)`` keeping first-seen field order."""
    cells, order = [], {}
    for c in profiles.columns:
        for m in METRIC_SUFFIXES:
            if c.endswith("_" + m) and c[: -len(m) - 1].strip():
                base = c[: -len(m) - 1].strip()
                order.setdefault(base, len(order))
                cells.append(F.struct(F.lit(base).alias("field"), F.lit(m).alias("metric"),
                                      F.col(c).cast("string").alias("value"), F.lit(order[base]).alias("ord")))
                break
    return profiles.select(F.col(id_col).alias("cluster_id"), F.explode(F.array(*cells)).alias("m")) \
        .select("cluster_id", "m.*")


def format_field_ref(field: Column, category: Column, short_label: Column, description: Column,
                     max_label_len: int = 80) -> Column:
    """``[category] label (FIELD)``; label = short label else description,
    whitespace-collapsed, cut to max-3 + '...' when longer."""
    lab = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.trim(short_label), F.lit("")),
                                             F.trim(F.coalesce(description, F.lit("")))), r"\s+", " "))
    if max_label_len:
        lab = F.when(F.length(lab) > max_label_len,
                     F.concat(F.substring(lab, 1, max_label_len - 3), F.lit("..."))).otherwise(lab)
    cat = F.trim(F.coalesce(category, F.lit("")))
    main = F.when(lab != "", F.concat(lab, F.lit(" ("), field, F.lit(")"))).otherwise(field)
    return F.when(cat != "", F.concat(F.lit("["), cat, F.lit("] "), main)).otherwise(main)


def _fixed3_series(s):
    return s.map(lambda v: None if v is None or v != v else f"{v:.3f}".rstrip("0").rstrip("."))


def _fixed3(x: Column) -> Column:
    """<= 3 decimals, trailing zeros stripped, rounded like Python (on the exact
    binary value).  Java's %.3f rounds the shortest decimal form half-up, which
    differs at ties, so this one formatter is an Arrow-batched Pandas UDF."""
    return F.pandas_udf(_fixed3_series, "string")(x.cast("double"))


def is_money_category(category: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    tok = F.lit(False)
    for t in MONEY_TOKENS:
        tok = tok | F.contains(c, F.lit(t))
    return (c != "") & (c.isin(MONEY_CATEGORIES) | tok)


def format_money_value(value: Column, category: Column, is_text: bool = False) -> Column:
    """Missing -> 'N/A'; text trimmed ('N/A' if blank); money categories
    -> '$1,234'; whole numbers >= 1000 -> '1,234'; else <= 3 decimals, zeros
    stripped."""
    if is_text:
        s = F.trim(value.cast("string"))
        return F.when(value.isNull() | (s == ""), F.lit("N/A")).otherwise(s)
    x = value.cast("double")
    money = F.concat(F.lit("$"), F.format_number(x, 0))
    whole = (F.abs(x) >= 1000) & (x == F.floor(x))
    txt = F.when(whole, F.format_number(x, 0)).otherwise(
        F.when(_fixed3(x) == "", F.lit("0")).otherwise(_fixed3(x)))
    return F.when(x.isNull() | F.isnan(x), F.lit("N/A")).when(is_money_category(category), money).otherwise(txt)


def format_survey_value(value: Column, integral: bool = False) -> Column:
    """Integers plain; integral floats without decimals; other floats with
    <= 3 decimals, zeros stripped; null -> null."""
    if integral:
        return value.cast("long").cast("string")
    x = value.cast("double")
    whole = x == F.floor(x)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string")) \
        .when(whole, x.cast("long").cast("string")).otherwise(_fixed3(x))


def tag_persona(personas: DataFrame, dataset: str | None, id_col: str = "cluster_id") -> DataFrame:
    """Dataset, cluster_id, ``persona_id = <dataset>_cluster_<id>`` (or
    ``_unknown``) and a source struct; existing values are kept."""
    ds = dataset or "unknown"
    cols = personas.columns
    cid = F.col(id_col)
    keep = lambda c, v: F.coalesce(F.col(c), v) if c in cols else v
    pid = F.when(cid.isNotNull(), F.concat(F.lit(f"{ds}_cluster_"), cid.cast("string"))) \
        .otherwise(F.lit(f"{ds}_cluster_unknown"))
    src = F.struct(F.lit(ds).alias("dataset"), cid.alias("cluster_id"),
                   (F.col("n_samples") if "n_samples" in cols else F.lit(None)).alias("n_samples"),
                   (F.col("percentage") if "percentage" in cols else F.lit(None)).alias("percentage"))
    return personas.withColumn("dataset", keep("dataset", F.lit(ds))) \
        .withColumn("persona_id", keep("persona_id", pid).cast("string")) \
        .withColumn("source", src)


def _fmt_series(spec: str):
    def f(s):
        return s.map(lambda v: "N/A" if v is None or v != v or v in (float("inf"), float("-inf")) else format(v, spec))
    return f


def py_format(x: Column, spec: str) -> Column:
    """Python ``format(x, spec)`` (exact-binary rounding, '%g' zero stripping) as
    an Arrow-batched Pandas UDF; null / NaN / inf -> 'N/A'."""
    return F.pandas_udf(_fmt_series(spec), "string")(x.cast("double"))


def profile_text(stats_long: DataFrame, sizes: DataFrame, max_modes: int = 18, max_cont: int = 10) -> DataFrame:
    """One summary text per cluster: size, share, up to ``max_modes``
    mode lines and ``max_cont`` numeric lines (mean / std), numbers as
    ``%.4g``.  ``stats_long(cluster_id, field, metric, num, txt, ord)`` (T9 form
    with the numeric value kept), ``sizes(cluster_id, n_samples, percentage)``."""
    s = stats_long.withColumn("fmt", F.when(F.col("metric") == "mode", F.coalesce(F.col("txt"), F.lit("N/A")))
                              .otherwise(py_format(F.col("num"), ".4g")))
    modes = s.where(F.col("metric") == "mode").select(
        "cluster_id", "ord", F.concat(F.lit("- "), F.col("field"), F.lit(": mode="), F.col("fmt")).alias("line"))
    nums = s.where(F.col("metric").isin("mean", "std", "median")).groupBy("cluster_id", "field", "ord").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "fmt"))).alias("m"))
    parts = F.concat_ws(", ", *[F.when(F.col("m")[k].isNotNull(), F.concat(F.lit(f"{k}="), F.col("m")[k]))
                                for k in ("mean", "std", "median")])
    nums = nums.select("cluster_id", "ord", F.concat(F.lit("- "), F.col("field"), F.lit(": "), parts).alias("line"))

    def block(df, k, title):
        w = df.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "line"))), 1, k).alias("l"))
        return w.select("cluster_id", F.concat(F.lit(title + "\n"), F.array_join(F.transform("l", lambda e: e["line"]), "\n"))
                        .alias(title.split()[0].lower()))
    mb = block(modes, max_modes, "Modes of categorical fields:")
    nb = block(nums, max_cont, "Numeric fields:")
    head = sizes.select("cluster_id", F.concat(F.lit("Cluster size: "), F.col("n_samples").cast("string"), F.lit("\nShare: "),
                                               py_format(F.col("percentage"), ".1f"), F.lit("%")).alias("head"))
    j = head.join(mb, "cluster_id", "left").join(nb, "cluster_id", "left")
    return j.select("cluster_id", F.concat_ws("\n\n", "head", "modes", "numeric").alias("profile_text"))


def field_dictionary(fields: DataFrame, metadata: DataFrame, max_fields: int = 25) -> DataFrame:
    """Up to ``max_fields`` distinct profile fields with metadata lines
    ``- field [category]: short — description``; fields without description and
    category are skipped.  ``fields(field, ord)`` is one row per profile field."""
    m = metadata.select(F.col("var_id").alias("field"), F.trim(F.coalesce("category", F.lit(""))).alias("cat"),
                        F.trim(F.coalesce("short_label", F.lit(""))).alias("short"),
                        F.trim(F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.col("var_name"), F.lit(""))).alias("desc"))
    j = fields.join(F.broadcast(m), "field").where((F.col("desc") != "") | (F.col("cat") != ""))
    shown = F.when(F.col("short") != "", F.col("short")).otherwise(F.col("desc"))
    line = F.concat(F.lit("- "), F.col("field"),
                    F.when(F.col("cat") != "", F.concat(F.lit(" ["), F.col("cat"), F.lit("]"))).otherwise(F.lit("")),
                    F.when(shown != "", F.concat(F.lit(": "), shown)).otherwise(F.lit("")),
                    F.when((F.col("short") != "") & (F.col("desc") != "") & (F.lower("short") != F.lower("desc")),
                           F.concat(F.lit(" — "), F.col("desc"))).otherwise(F.lit("")))
    lines = j.select("ord", line.alias("line"))
    return lines.agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "line"))), 1, max_fields),
                                              lambda e: e["line"]), "\n").alias("dictionary"))


# Name keywords that reveal a field category (lower-case substring match)
CATEGORY_KEYWORDS = {
    "demographics": ["age", "sex", "gender", "marit", "race", "ethnic", "hhsize", "family", "child"],
    "income": ["income", "inc", "earn", "wage", "salary", "poverty"],
    "consumption": ["share", "consumption", "spending"],
    "education_investment": ["education", "student_debt", "tuition"],
    "assets": ["wealth", "asset", "stock", "property"],
    "debt": ["debt", "mortgage", "loan"],
    "employment_behavior": ["employ", "job", "work", "occupation"],
    "financial_behavior": ["risk", "savings", "budget", "planning", "invest", "financial_health"],
    "housing_behavior": ["housing", "house", "home", "rent"],
    "health_behavior": ["health", "medical", "insurance"],
    "time_use_lifestyle": ["work_hours", "commute", "leisure"],
    "attitudes_expectations": ["satisfaction", "expectation", "attitude"],
    "program_participation": ["snap", "medicaid", "medicare", "ssi", "tanf", "wic", "unemployment", "program", "benefit"],
}


def detect_categories(fields: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Categories present among ``fields(field)`` (profile keys and sample
    columns): metadata categories of the base names (``_mean/_median/_mode``
    stripped, not ``_std``) plus name-keyword rules.  The keyword table is a
    small fixed literal; returns distinct ``category`` rows."""
    f = fields.select(F.col("field").cast("string").alias("field"))
    low = F.lower(F.col("field"))
    named = F.array(*[F.when(F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(low, t)), F.lit(c))
                      for c, tokens in CATEGORY_KEYWORDS.items()])
    out = f.select(F.explode(F.array_compact(named)).alias("category"))
    if metadata is not None:
        base = F.regexp_replace(F.col("field"), r"_(mean|median|mode)$", "")
        meta = metadata.select(F.col("var_id").alias("base"), F.col("category").alias("mcat"))
        by_meta = f.select(base.alias("base")).join(F.broadcast(meta), "base") \
            .where(F.col("mcat").isNotNull() & (F.col("mcat") != "")).select(F.col("mcat").alias("category"))
        out = out.unionByName(by_meta)
    return out.distinct()


def fit_prompt_table(pairs: DataFrame, values_long: DataFrame, persona_stats_long: DataFrame,
                     supplementary: DataFrame | None = None, max_lines: int = 200) -> DataFrame:
    """One prompt text per (household, persona) pair: for every persona
    statistic whose field the household has, an aligned line
    ``- field: household=<value>, persona=<mean/std or mode>`` (field order of
    the profile, at most ``max_lines``), then the household's supplementary
    fields (W18).  ``values_long(hid, field, value)``; ``persona_stats_long
    (persona_id, field, metric, num, txt, ord)`` is bounded (personas x fields)
    and broadcast."""
    ps = persona_stats_long.withColumn("fmt", F.when(F.col("metric") == "mode", F.coalesce("txt", F.lit("N/A")))
                                       .otherwise(py_format(F.col("num"), ".4g")))
    per = ps.groupBy("persona_id", "field", "ord").agg(F.map_from_entries(F.collect_list(F.struct("metric", "fmt"))).alias("m"))
    desc = F.when(F.col("m")["mode"].isNotNull(), F.concat(F.lit("mode "), F.col("m")["mode"])).otherwise(
        F.concat(F.lit("mean "), F.coalesce(F.col("m")["mean"], F.lit("N/A")), F.lit(" / std "),
                 F.coalesce(F.col("m")["std"], F.lit("N/A"))))
    per = per.select("persona_id", "field", "ord", desc.alias("persona_txt"))
    v = values_long.select("hid", "field", F.coalesce(F.trim(F.col("value").cast("string")), F.lit("N/A")).alias("hh"))
    j = pairs.select("hid", "persona_id").join(v, "hid").join(per, ["persona_id", "field"])
    line = F.concat(F.lit("- "), F.col("field"), F.lit(": household="), F.col("hh"), F.lit(", persona="), F.col("persona_txt"))
    aligned = j.groupBy("hid", "persona_id").agg(F.array_join(F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), 1, max_lines), lambda e: e["l"]), "\n")
        .alias("aligned"))
    out = pairs.select("hid", "persona_id").join(aligned, ["hid", "persona_id"], "left")
    if supplementary is not None:
        sup = supplementary.groupBy("hid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "pos", F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("field"), F.lit("): "), F.col("value")).alias("l")))),
            lambda e: e["l"]), "\n").alias("supp"))
        out = out.join(sup, "hid", "left")
    else:
        out = out.withColumn("supp", F.lit(None).cast("string"))
    return out.select("hid", "persona_id", F.concat_ws(
        "\n\n", F.concat(F.lit("Household vs persona "), F.col("persona_id").cast("string"), F.lit(":\n"),
                         F.coalesce("aligned", F.lit("(no shared fields)"))),
        F.when(F.col("supp").isNotNull(), F.concat(F.lit("Additional household fields:\n"), F.col("supp")))).alias("prompt"))


def survey_prompt_table(households: DataFrame, concepts: dict[str, list[str]], persona_names: DataFrame,
                        max_lines: int = 15, id_col: str = "hid", persona_col: str = "persona_id") -> DataFrame:
    """Household description for the questionnaire: for each concept the
    first non-null of its candidate columns (text trimmed, numbers via the T12
    rules), at most ``max_lines`` lines, plus the persona name.  Finance
    concepts are simply not listed in ``concepts``.  Persona names are one row
    per persona (broadcast)."""
    lines = []
    for concept, cols in concepts.items():
        present = [c for c in cols if c in households.columns]
        if not present:
            continue
        vals = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in present]
        lines.append(F.when(F.coalesce(*vals).isNotNull(),
                            F.concat(F.lit(f"- {concept}: "), F.coalesce(*vals))))
    arr = F.slice(F.filter(F.array(*lines), lambda s: s.isNotNull()), 1, max_lines) if lines else F.array()
    h = households.select(F.col(id_col).alias("hid"), F.col(persona_col).alias("persona_id"),
                          F.array_join(arr, "\n").alias("desc"))
    names = persona_names.select("persona_id", "persona_name")
    return h.join(names, "persona_id", "left").select(
        "hid", "persona_id", F.concat(F.lit("Persona: "), F.coalesce("persona_name", F.lit("Unknown")),
                                      F.lit("\nHousehold:\n"), F.col("desc")).alias("prompt"))
