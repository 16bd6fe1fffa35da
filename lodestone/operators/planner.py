"""The rule-first planner of requirement questions: slots by a substring join, then ordered rules.

All questions are planned in one pass. The names of projects, atoms and customers meet the questions that
contain them through short character grams, and what remains of the rules is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, literal_map
from lodestone.operators.joins import substrings
from lodestone.operators.ranking import keep_best

# Words that speak for an intent, in the order in which intents are tried, and names of atoms.
ECO = ["eco", "工程变更", "变更单", "工程变更单", "change order", "engineering change"]
GATE = ["发布门禁", "准入", "是否可以进入", "能否进入", "release readiness", "release gate", "dv", "pv", "sop"]
GATE_ASKED = ["门禁", "准入", "是否可以", "能否", "readiness", "gate", "进入"]
BASELINE = ["需求基线", "项目基线", "baseline", "基线版本", "冻结版本", "版本冻结", "回滚", "漂移"]
PACKAGES = ["需求包", "导入包", "项目需求包", "import package", "package import", "requirement package"]
CANDIDATES = ["候选需求", "待归类", "待评审需求", "抽取结果", "需要人工确认", "candidate", "candidates"]
IMPACT = ["影响哪些", "影响范围", "变更影响", "改成", "改为", "调整为", "impact", "change impact"]
COMPLIANCE = ["是否满足", "是否符合", "合规", "符合性", "测试覆盖", "测试结果", "compliance", "pass/fail"]
REVIEW = ["需要审批", "审批状态", "评审", "review", "approval"]
CONFLICT = ["冲突", "放宽", "缺证据", "缺少证据", "风险"]
DIFF = ["差异", "改了哪些", "相对", "不同", "diff"]
ATOM_ALIASES = {
    "REQATOM-DCDC-OUTPUT-RIPPLE": ["输出纹波", "纹波", "纹波电压", "ripple", "output ripple"],
    "REQATOM-DCDC-EFFICIENCY": ["效率", "满载效率", "efficiency"],
    "REQATOM-DCDC-SLEEP-CURRENT": ["休眠电流", "静态电流", "sleep current", "sleep-current"],
}
UNITS = {"毫伏": "mV", "mv": "mV", "伏": "V", "ma": "mA", "毫安": "mA", "percent": "%"}
_NUMBER = r"(\d+(?:\.\d+)?)\s*([a-z%μµ毫伏安]*)"
_CHANGED = r"(?:改成|改为|变成|调整为|to)\s*[≤<>=]*\s*" + _NUMBER
REASONS = {
    "gate_project": "The query asks for release readiness but no project could be resolved.",
    "impact_atom": "The query asks for change impact but no requirement atom could be resolved.",
    "impact_customer": "The query asks for change impact but no customer/common profile could be resolved.",
    "impact_variant": "No customer-common requirement variant was found for the resolved customer and atom.",
    "impact_value": "The proposed new value could not be parsed from the query.",
    "compliance_project": "The query asks for compliance but no project could be resolved.",
    "conflict_project": "The query asks for conflicts but no project could be resolved.",
    "diff_project": "The query asks for project differences but no project could be resolved.",
    "diff_profile": "No customer-common profile was found for the resolved project.",
    "project": "No project could be resolved. Requirement answers must be project-scoped.",
    "atom": "No requirement atom could be resolved from the query.",
}


def normalised(question: Column) -> Column:
    return F.translate(F.lower(F.trim(question)), "／，", "/,")


def _named(questions: DataFrame, names: DataFrame, item: str) -> DataFrame:
    """(question_id, item, n): the least item of which a question contains a name, and how many there are."""
    hits = substrings(questions, "question_id", "q", names, "name").join(names, "name")
    return hits.groupBy("question_id").agg(F.min(item).alias(item), F.count_distinct(item).alias("n"))


def _names(df: DataFrame, item: str, *columns: str) -> DataFrame:
    return df.select(item, F.explode(F.array(*(F.lower(F.col(c)) for c in columns))).alias("name")).filter("name <> ''").distinct()


def plan(questions: DataFrame, projects: DataFrame, atoms: DataFrame, customers: DataFrame, profiles: DataFrame, variants: DataFrame) -> DataFrame:
    """A row a question: intent, slots, confidence and, where a slot is missing or ambiguous, why it must be asked again.

    questions: question_id, question; projects: project_id, customer_id, project_code, project_name; atoms: atom_id,
    canonical_name, parameter_name; customers: customer_id, customer_name, customer_code (active ones); profiles:
    profile_id, customer_id, updated_at (active customer-common ones); variants: variant_id, customer_id, atom_id, priority,
    updated_at (of such profiles). A name counts wherever it stands in a question; a slot is filled if one item is named.
    A question that names no project may name one by its number (`P3` for codes that end in `-p3`)."""
    q = questions.select("question_id", normalised(F.col("question")).alias("q"))
    aliases = F.explode(F.coalesce(literal_map({k: v for k, v in ATOM_ALIASES.items()})[F.col("atom_id")], F.array().cast("array<string>")))
    atom_names = _names(atoms, "atom_id", "atom_id", "canonical_name", "parameter_name").unionByName(atoms.select("atom_id", aliases.alias("name"))).distinct()
    project, atom, customer = (
        _named(q, _names(projects, "project_id", "project_id", "project_code", "project_name"), "project_id"),
        _named(q, atom_names, "atom_id"),
        _named(q, _names(customers, "customer_id", "customer_id", "customer_name", "customer_code"), "customer_id"),
    )
    ends = projects.select("project_id", F.explode(F.array(*(F.regexp_extract(F.lower(c), r"-(p\d+)$", 1) for c in ("project_id", "project_code")))).alias("short")).filter("short <> ''").distinct()
    asked = q.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"p\s*[-_]?\s*(\d+)"), F.lit(1)))).alias("number")).withColumn("short", F.concat(F.lit("p"), "number"))
    short = asked.join(ends, "short").groupBy("question_id").agg(F.min("project_id").alias("short_id"), F.count_distinct("project_id").alias("short_n"))
    one = lambda c, n: F.when(F.col(n) == 1, F.col(c))
    rows = (
        q.join(project.withColumnRenamed("n", "p_n"), "question_id", "left").join(short, "question_id", "left")
        .join(atom.withColumnRenamed("n", "a_n"), "question_id", "left").join(customer.withColumnRenamed("n", "c_n"), "question_id", "left")
        .select("question_id", "q", F.when(F.col("p_n").isNull(), one("short_id", "short_n")).otherwise(one("project_id", "p_n")).alias("project"), one("atom_id", "a_n").alias("atom"), one("customer_id", "c_n").alias("customer"))
    )
    common = keep_best(profiles, ["customer_id"], F.desc("updated_at"), F.asc("profile_id")).select("customer_id", F.col("profile_id").alias("base"))
    owner = projects.select(F.col("project_id").alias("project"), "customer_id").join(common, "customer_id").select("project", "base")
    chosen = keep_best(variants, ["customer_id", "atom_id"], F.asc("priority"), F.desc("updated_at"), F.asc("variant_id")).select(F.col("customer_id").alias("customer"), F.col("atom_id").alias("atom"), F.col("variant_id").alias("variant"))
    rows = rows.join(owner, "project", "left").join(chosen, ["customer", "atom"], "left")
    text = F.col("q")
    last = lambda g: F.element_at(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(g)), -1)
    stated = F.regexp_extract(text, _CHANGED, 1) != ""
    has_number = F.regexp_extract(text, _NUMBER, 1) != ""
    number = F.when(stated, F.regexp_extract(text, _CHANGED, 1)).when(has_number, last(1))
    raw_unit = F.when(stated, F.regexp_extract(text, _CHANGED, 2)).when(has_number, last(2))
    unit = F.nullif(F.coalesce(literal_map(UNITS)[raw_unit], raw_unit), F.lit(""))
    return rows.select("*", number.cast("double").alias("value"), unit.alias("unit")).select("question_id", _decided().alias("d"), "*").select(
        "question_id", "d.intent", *(F.when(F.array_contains("d.slots", s), F.col(c)).alias(n) for s, c, n in _SLOTS),
        F.when(F.array_contains("d.slots", "stage"), F.when(F.contains(text, F.lit("sop")), "SOP").when(F.contains(text, F.lit("pv")), "PV").otherwise("DV")).alias("release_stage"),
        F.when(F.array_contains("d.slots", "eco"), F.nullif(F.upper(F.regexp_extract(text, "eco-[a-z0-9_.-]+", 0)), F.lit(""))).alias("eco_id"),
        "d.confidence", "d.reason",
    )


_SLOTS = (("project", "project", "project_id"), ("atom", "atom", "atom_id"), ("base", "base", "base_profile_id"), ("variant", "variant", "variant_id"), ("value", "value", "proposed_value"), ("value", "unit", "proposed_unit"))


def _decided() -> Column:
    """intent, the slots that its plan carries, confidence and reason; the first rule that holds decides."""
    missing = {c: F.col(c).isNull() for c in ("project", "atom", "customer", "variant", "base", "value")}
    says = lambda words: contains_any("q", words)

    def plan_(intent: str, slots: str, confidence: float, reason: str | None = None) -> Column:
        kept = F.array(*map(F.lit, slots.split())) if slots else F.array().cast("array<string>")
        return F.struct(F.lit(intent).alias("intent"), kept.alias("slots"), F.lit(confidence).alias("confidence"), F.lit(reason and REASONS[reason]).cast("string").alias("reason"))

    ask = lambda reason, slots="", confidence=0.6: plan_("clarification_required", slots, confidence, reason)
    rules = [
        (says(ECO), plan_("requirement_eco", "project atom eco", 0.76)),
        (says(GATE) & says(GATE_ASKED) & missing["project"], ask("gate_project")),
        (says(GATE) & says(GATE_ASKED), plan_("requirement_release_gate", "project atom stage", 0.84)),
        (says(BASELINE), plan_("requirement_baseline", "project atom", 0.78)),
        (says(PACKAGES), plan_("requirement_import_packages", "project atom", 0.74)),
        (says(CANDIDATES), plan_("requirement_candidates", "project atom", 0.78)),
        (says(IMPACT) & missing["atom"], ask("impact_atom")),
        (says(IMPACT) & missing["customer"], ask("impact_customer", "atom")),
        (says(IMPACT) & missing["variant"], ask("impact_variant", "atom")),
        (says(IMPACT) & missing["value"], ask("impact_value", "atom variant")),
        (says(IMPACT), plan_("requirement_impact", "atom variant value", 0.82)),
        (says(COMPLIANCE) & missing["project"], ask("compliance_project", "atom")),
        (says(COMPLIANCE), plan_("requirement_compliance", "project atom", 0.85)),
        (says(REVIEW), plan_("requirement_review", "project", 0.78)),
        (says(CONFLICT) & missing["project"], ask("conflict_project")),
        (says(CONFLICT), plan_("requirement_conflict_scan", "project", 0.8)),
        (says(DIFF) & missing["project"], ask("diff_project")),
        (says(DIFF) & missing["base"], ask("diff_profile", "project")),
        (says(DIFF), plan_("requirement_diff", "project base", 0.85)),
        (missing["project"], ask("project", "atom", 0.5)),
        (missing["atom"], ask("atom", "project", 0.5)),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(plan_("requirement_effective", "project atom", 0.9))
