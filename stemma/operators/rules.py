"""Declarative rules: conditions, policies, routing, scoped variables, revisions.

Rules are few and known when a query is planned, so they are compiled to Columns
or joined as a literal table; no rule is evaluated row by row in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ulid
from ..session import checkpointed, forget

#: Change types of signals, scopes from broad to narrow, and the allowed steps of a revision.
SIGNAL_CHANGES = {
    "file_modified": "state", "file_created": "state", "file_deleted": "state", "git_commit": "state",
    "git_branch_created": "hierarchy", "git_branch_deleted": "hierarchy", "registry_updated": "state",
    "edge_added": "relation", "edge_removed": "relation", "promotion_changed": "state",
    "content_drift": "semantic", "metric_spike": "anomaly",
}
SCOPES = ["global", "organ", "repo", "module", "document", "session"]
STEPS = {
    "detected": ["accumulating", "cancelled"], "accumulating": ["evaluating", "cancelled"], "evaluating": ["proposed", "rejected"],
    "proposed": ["approved", "rejected"], "approved": ["applied"], "applied": [], "rejected": [], "cancelled": [],
}
DIMENSIONS = ("function", "material", "pattern", "scope", "security")


def condition(field: str | Column, operator: str, value, listed: bool = False) -> Column:
    """A condition as a Column; null is equal to null, ordered with nothing; an unknown operator never holds. ``contains`` looks for
    an item where the field is an array (``listed``), and for a part of the text otherwise."""
    c = F.col(field) if isinstance(field, str) else field
    v = value if isinstance(value, (list, tuple)) else F.lit(value)
    if operator == "eq":
        return c.eqNullSafe(v)
    if operator == "ne":
        return ~c.eqNullSafe(v)
    if operator in ("in", "not_in"):
        some = [x for x in v if x is not None]
        held = F.coalesce(c.isin(some), F.lit(False)) | (c.isNull() & F.lit(None in v))
        return held if operator == "in" else ~held
    if operator == "contains":
        made = F.array_contains(c, v) if listed else c.cast("string").contains(F.lit(value).cast("string"))
    else:
        made = {"gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}.get(operator, F.lit(False))
    return F.coalesce(made, F.lit(False))


def holds(policy: dict, arrays: frozenset[str] = frozenset()) -> Column:
    """All conditions; a disabled policy never, one without conditions always. arrays: the fields that are arrays."""
    if not policy.get("enabled", True):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [condition(*c, listed=c[0] in arrays) for c in policy.get("conditions", [])], F.lit(True))


def evaluate_policies(entities: DataFrame, policies: list[dict]) -> DataFrame:
    """uid, policy_id, action, priority, place: the policies that hold of each entity, by priority; one pass over the entities."""
    arrays = frozenset(f.name for f in entities.schema if f.dataType.typeName() == "array")
    fits = lambda p: holds(p, arrays) & (F.lit(True) if not p.get("scope") else F.col("entity_type") == p["scope"])
    made = [F.when(fits(p), F.struct((-F.lit(p.get("priority", 0))).alias("neg"), F.lit(i).alias("seq"), F.lit(p["policy_id"]).alias("policy_id"), F.lit(p["action"]).alias("action"))) for i, p in enumerate(policies)]
    found = F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull()))
    rows = entities.select("uid", F.posexplode(found).alias("place", "x"))
    return rows.select("uid", "x.policy_id", "x.action", (-F.col("x.neg")).alias("priority"), (F.col("place") + 1).cast("long").alias("place"))


def route(artifacts: DataFrame, rules: list[dict], fallback: str = "intake/") -> DataFrame:
    """All columns of ``artifacts`` with rule_id and target of the first rule whose keys all equal the artifact's; an unknown key never matches."""

    def fits(match) -> Column:
        parts = [F.coalesce(F.col(k) == v, F.lit(False)) if k in DIMENSIONS else F.lit(False) for k, v in match.items()]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    out = F.lit(None).cast("struct<rule_id:int,target:string>")
    for rule in reversed([r for r in rules if isinstance(r.get("match", {}), dict)]):
        number = int(rule["id"]) if rule.get("id") else None
        out = F.when(fits(rule.get("match", {})), F.struct(F.lit(number).cast("int").alias("rule_id"), F.lit(rule["target"]).alias("target"))).otherwise(out)
    rows = artifacts.withColumn("__rule", out)
    return rows.select(*artifacts.columns, "__rule.rule_id", F.coalesce("__rule.target", F.lit(fallback)).alias("target"))


def normalize(signals: DataFrame) -> DataFrame:
    """Signals with an entity and a known type, as changes."""
    kinds = F.create_map(*[F.lit(x) for kv in SIGNAL_CHANGES.items() for x in kv])
    rows = signals.where((F.col("entity_id") != "") & F.col("entity_id").isNotNull()).withColumn("change_type", F.try_element_at(kinds, F.col("signal_type")))
    return rows.where("change_type is not null").withColumnRenamed("signal_type", "property_name").withColumnRenamed("sensor_name", "source_sensor")


def scope_rank(scope: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SCOPES]), scope)


def scope_chain(scope: Column) -> Column:
    """The scopes from ``scope`` to the broadest; an unknown one has none."""
    return F.reverse(F.slice(F.array(*[F.lit(s) for s in SCOPES]), F.lit(1), F.coalesce(scope_rank(scope), F.lit(0)).cast("int")))


def broken(value: Column, constraint: Column) -> Column:
    """The first part of a constraint (a struct of allowed_values, min_value, max_value, pattern, required) that a text value
    breaks, or null; null breaks ``required`` only, text that isn't a number no bound, and a missing constraint nothing."""
    number = value.try_cast("double")
    parts = [
        (value.isNull() & constraint["required"], "required"), (~F.array_contains(constraint["allowed_values"], value), "allowed_values"),
        (number < constraint["min_value"], "min_value"), (number > constraint["max_value"], "max_value"),
        (~F.rlike(value, F.concat(F.lit("^(?:"), constraint["pattern"], F.lit(")"))), "pattern"),
    ]
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in parts])


_OWN = ["key", "scope", "entity_id"]


def _valid(log: DataFrame) -> DataFrame:
    return log.where(broken(F.col("value"), F.col("constraint")).isNull()) if "constraint" in log.columns else log


def refused_sets(log: DataFrame) -> DataFrame:
    """seq, reason of the sets in a log that change nothing: the part of their constraint that they break, or ``constant``."""
    first = _valid(log).where("mutability = 'constant'").groupBy(*[F.col(c).alias(f"__{c}") for c in _OWN]).agg(F.min("seq").alias("__first"))
    same = reduce(lambda a, b: a & b, [log[c].eqNullSafe(first[f"__{c}"]) for c in _OWN])
    bad = broken(F.col("value"), F.col("constraint")) if "constraint" in log.columns else F.lit(None).cast("string")
    reason = F.coalesce(bad, F.when(F.col("seq") > F.col("__first"), "constant"))
    return log.join(first, same, "left").select("seq", reason.alias("reason")).where("reason is not null")


def set_variables(log: DataFrame) -> DataFrame:
    """The variables that a log of sets leaves: for each key, scope and entity the first constant if there is one, else the last; at
    the first's place. Sets that break their own constraint (a column ``constraint``, where there is one) are refused."""
    own, log = _OWN, _valid(log)
    row = F.struct("value", "mutability")
    constant = F.min_by(F.when(F.col("mutability") == "constant", row), F.when(F.col("mutability") == "constant", F.col("seq")))
    kept = log.groupBy(*own).agg(F.coalesce(constant, F.max_by(row, "seq")).alias("x"), F.min("seq").alias("seq"))
    return kept.select("seq", *own, "x.value", "x.mutability")


def list_keys(variables: DataFrame) -> DataFrame:
    return variables.select("key").distinct()


def list_at_scope(variables: DataFrame, scope: str, entity_id: str | None = None) -> DataFrame:
    rows = variables.where(F.col("scope") == scope)
    return rows.where(F.col("entity_id") == entity_id) if entity_id is not None else rows


def get_variables(variables: DataFrame, wanted: DataFrame) -> DataFrame:
    """The variables of exactly these (key, scope, entity_id), nulls being equal: no scope inherits."""
    asked = wanted.select(*[F.col(c).alias(f"__{c}") for c in _OWN]).distinct()
    return variables.join(asked, reduce(lambda a, b: a & b, [variables[c].eqNullSafe(asked[f"__{c}"]) for c in _OWN]), "left_semi")


def delete_variables(variables: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left without these (key, scope, entity_id); constants stay."""
    asked = gone.select(*[F.col(c).alias(f"__{c}") for c in _OWN]).distinct()
    same = reduce(lambda a, b: a & b, [variables[c].eqNullSafe(asked[f"__{c}"]) for c in _OWN])
    return variables.join(asked, same & ~variables["mutability"].eqNullSafe("constant"), "left_anti")


def find_in_chain(wanted: DataFrame, variables: DataFrame) -> DataFrame:
    """``found_in_chain`` without the mutability."""
    return found_in_chain(wanted, variables).drop("mutability")


def found_in_chain(wanted: DataFrame, variables: DataFrame) -> DataFrame:
    """For requests (request_id, key, scope, chain: map of scope to entity) the variable found from the narrow to the broad scope.

    A variable of another entity doesn't fit; one without entity, or a scope without entity in the chain, fits any.
    The first variable of each key, scope and entity is joined by all three: by key alone the pairs grow with the square of a key.
    """
    own, none, every = F.struct(F.lit("own").alias("kind"), F.col("entity_id").alias("entity")), _place("none"), _place("any")
    kind = F.col("mutability") if "mutability" in variables.columns else F.lit("runtime")
    v = variables.select("key", F.col("scope").alias("found_scope"), "entity_id", "value", kind.alias("mutability"), "seq", F.explode(F.array(every, F.when(F.col("entity_id").isNull(), none).otherwise(own))).alias("place"))
    first = v.groupBy("key", "found_scope", "place.kind", F.coalesce("place.entity", F.lit("")).alias("entity")).agg(F.min_by(F.struct(F.col("entity_id").alias("found_entity"), "value", "mutability"), "seq").alias("x"), F.min("seq").alias("seq"))
    scopes = variables.agg(F.collect_set("scope").alias("__scopes"))
    rows = wanted.crossJoin(F.broadcast(scopes)).withColumn("found_scope", F.explode("__scopes")).where(scope_rank(F.col("found_scope")) <= scope_rank(F.col("scope")))
    asked = F.try_element_at("chain", F.col("found_scope"))
    fits = F.when(asked.isNull(), F.array(every)).otherwise(F.array(none, F.struct(F.lit("own").alias("kind"), asked.alias("entity"))))
    rows = rows.withColumn("place", F.explode(fits)).select("request_id", "key", "scope", "found_scope", "place.kind", F.coalesce("place.entity", F.lit("")).alias("entity"))
    rows = rows.join(first, ["key", "found_scope", "kind", "entity"])
    best = F.min_by(F.struct("found_scope", "x.found_entity", "x.value", "x.mutability"), F.struct(-scope_rank(F.col("found_scope")), F.col("seq")))
    return rows.groupBy("request_id", "key", "scope").agg(best.alias("x")).select("request_id", "key", "scope", "x.*")


def _place(kind: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("entity"))


def _from(environment: dict[str, str], name: Column, default: str | None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in environment.items() for x in kv]) if environment else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, name), F.lit(default).cast("string"))


def referred(variables: DataFrame, environment: dict[str, str]) -> DataFrame:
    """__key, __target: what a reference to a key gives: the first global variable of that key, through further references.

    Pointer doubling over the global variables: a round halves what is left of each chain. References in a circle raise.
    """
    globals_ = variables.where("scope = 'global'").groupBy("key").agg(F.min_by(F.struct("value", "mutability"), "seq").alias("x")).select("key", "x.*")
    outside = F.col("mutability") == "environment"
    name = F.when(F.coalesce("value", F.lit("")) == "", F.col("key")).otherwise(F.col("value"))
    end = F.coalesce(F.col("mutability") != "reference", F.lit(True)) | F.col("value").isNull()
    t = globals_.select("key", F.when(outside, _from(environment, name, None)).otherwise(F.col("value")).alias("value"), end.alias("done"))
    t = checkpointed(t)
    for _ in range(max(2, t.count()).bit_length() + 2):
        if not t.where("not done").limit(1).count():
            return t.select(F.col("key").alias("__key"), F.col("value").alias("__target"))
        to = t.select(F.col("key").alias("__to"), F.col("value").alias("__value"), F.col("done").alias("__done"))
        step = t.join(to, ~F.col("done") & (F.col("value") == F.col("__to")), "left")
        old, t = t, checkpointed(step.select("key", F.when(F.col("done"), F.col("value")).otherwise(F.col("__value")).alias("value"), (F.col("done") | F.coalesce("__done", F.lit(True))).alias("done")))
        forget(old)
    raise ValueError("variables refer to each other in a circle")


def resolve_variables(wanted: DataFrame, variables: DataFrame, default: str | None = None, environment: dict[str, str] | None = None) -> DataFrame:
    """As find_in_chain, for every request: source is direct, inherited, environment, reference or default.

    A variable of mutability ``environment`` names an entry of ``environment`` (by its value, else its key), ``default`` where
    there is none; one of mutability ``reference`` names a global variable, null where there is none.
    """
    environment = environment or {}
    found = found_in_chain(wanted, variables).select("request_id", "found_scope", "value", "mutability")
    out = wanted.select("request_id", "key", "scope").join(found, "request_id", "left")
    if "mutability" in variables.columns:
        out = out.join(referred(variables, environment), (F.col("mutability") == "reference") & (F.col("value") == F.col("__key")), "left")
    else:
        out = out.withColumn("__target", F.lit(None).cast("string"))
    kind, none = F.col("mutability"), F.col("found_scope").isNull()
    name = F.when(F.coalesce("value", F.lit("")) == "", F.col("key")).otherwise(F.col("value"))
    source = F.when(none, "default").when(kind == "environment", "environment").when((kind == "reference") & F.col("value").isNotNull(), "reference")
    source = source.when(F.col("found_scope") == F.col("scope"), "direct").otherwise("inherited")
    value = F.when(none, F.lit(default)).when(kind == "environment", _from(environment, name, default)).when((kind == "reference") & F.col("value").isNotNull(), F.col("__target")).otherwise(F.col("value"))
    return out.select("request_id", "key", "scope", value.alias("value"), source.alias("source"))


def overrides(variables: DataFrame, key: str) -> DataFrame:
    """All variables of a key, narrow scopes first."""
    rows = variables.where(F.col("key") == key)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(scope_rank(F.col("scope"))), "seq"))
    return rows.select("key", "scope", "entity_id", "value", place.alias("place"))


def create_revisions(requests: DataFrame, millis: Column) -> DataFrame:
    """New revisions, all ``detected``, from requests (key, title, action, affected_entities, triggered_by)."""
    none = F.array().cast("array<string>")
    return requests.select(
        F.concat(F.lit("rev_"), ulid(millis, F.col("key"))).alias("revision_id"), "title", F.lit("detected").alias("status"), F.coalesce("action", F.lit("")).alias("action"),
        F.coalesce("affected_entities", none).alias("affected_entities"), F.coalesce("triggered_by", F.lit("manual")).alias("triggered_by"),
    )


def evidence_of(evidence: DataFrame) -> DataFrame:
    """revision_id, evidence_count, last_type, last_description, updated_at, from an appended log of evidence (revision_id, seq,
    evidence_type, description, ts): one partial aggregate, whatever the number of pieces."""
    last = F.max_by(F.struct("evidence_type", "description", "ts"), "seq").alias("x")
    rows = evidence.groupBy("revision_id").agg(F.count("*").alias("evidence_count"), last)
    return rows.select("revision_id", "evidence_count", F.col("x.evidence_type").alias("last_type"), F.col("x.description").alias("last_description"), F.col("x.ts").alias("updated_at"))


#: Steps of a revision are first folded in ranges of this many seqs, then ranges in groups of ``FAN``.
SPAN, FAN = 1 << 14, 1 << 8


def fold_revisions(steps: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """revision_id, status, accepted, refused: ordered steps (revision_id, seq, status) folded from ``detected`` on; a step that
    isn't allowed, or to an unknown status, changes nothing and is refused.

    A range of steps is a function of the status before it: for each of the statuses, the one after it and how many steps were
    accepted and refused. Functions of adjoining ranges compose, so a revision of any length is folded in ranges of bounded size,
    in as many rounds as its seqs have digits.
    """
    states = list(STEPS)
    number = F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))])
    allowed = F.array(*[F.lit(sum(1 << states.index(t) for t in STEPS[s])) for s in states])
    kind = "array<struct<s:int,a:long,r:long>>"
    still = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r")) for i in range(len(states))]).cast(kind)

    def step(acc, x):
        return F.transform(acc, lambda f: F.when(F.coalesce(F.get(allowed, f["s"]).bitwiseAND(F.call_function("shiftleft", F.lit(1), x["to"])) != 0, F.lit(False)),
                                                 F.struct(x["to"].alias("s"), (f["a"] + 1).alias("a"), f["r"].alias("r"))).otherwise(F.struct(f["s"].alias("s"), f["a"].alias("a"), (f["r"] + 1).alias("r"))))

    def then(acc, x):
        return F.transform(acc, lambda f: F.struct(x["f"][f["s"]]["s"].alias("s"), (f["a"] + x["f"][f["s"]]["a"]).alias("a"), (f["r"] + x["f"][f["s"]]["r"]).alias("r")))

    rows = steps.select("revision_id", "seq", F.try_element_at(number, F.col("status")).alias("to"))
    spans = rows.groupBy("revision_id", F.expr(f"seq div {span}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("seq", "to"))).alias("x"))
    spans = checkpointed(spans.select("revision_id", "b", F.aggregate("x", still, step).alias("f")))
    while (most := spans.agg(F.max(F.abs("b"))).first()[0]) is not None and most > 0:
        wider = spans.groupBy("revision_id", F.expr(f"b div {fan}").alias("wide")).agg(F.array_sort(F.collect_list(F.struct("b", "f"))).alias("x"))
        new = checkpointed(wider.select("revision_id", F.col("wide").alias("b"), F.aggregate("x", still, then).alias("f")))
        forget(spans)
        spans = new
    first = F.get("f", 0)  # of the status that revisions begin with
    names = F.array(*[F.lit(s) for s in states])
    return spans.select("revision_id", names[first["s"]].alias("status"), first["a"].cast("int").alias("accepted"), first["r"].cast("int").alias("refused"))


def route_by_table(artifacts: DataFrame, rules: DataFrame, fallback: str = "intake/") -> DataFrame:
    """As ``route``, with the rules as a table: place, rule_id, target and the five dimensions, null where a rule doesn't ask for one.

    Of the 32 sets of dimensions only those that rules use are tried: a distinct combination of an artifact's dimensions comes
    once for each, with the values of these dimensions as the key of one equi-join; of what it finds the smallest place wins.
    Artifacts meet the resolved combinations, not the rules, so neither table's size multiplies the other's.
    """
    mask = reduce(lambda a, b: a + b, [F.when(F.col(d).isNotNull(), 1 << i).otherwise(0) for i, d in enumerate(DIMENSIONS)])
    key = F.to_json(F.struct(*DIMENSIONS))
    index = rules.groupBy(mask.alias("mask"), key.alias("key")).agg(F.min(F.struct("place", "rule_id", "target")).alias("rule"))
    index = checkpointed(index)
    used = [r["mask"] for r in index.select("mask").distinct().collect()]  # 32 at most
    combinations = checkpointed(artifacts.select(*DIMENSIONS).distinct().withColumn("own", mask))
    asked = F.filter(F.array(*[F.lit(m) for m in used]).cast("array<int>"), lambda m: m.bitwiseAND(F.col("own")) == m)
    tried = combinations.select(*DIMENSIONS, F.explode(asked).alias("mask"))
    only = F.to_json(F.struct(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(d)).alias(d) for i, d in enumerate(DIMENSIONS)]))
    found = tried.withColumn("key", only).join(index, ["mask", "key"]).groupBy(*DIMENSIONS).agg(F.min("rule").alias("__rule"))
    found = found.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "__rule")
    same = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS])
    return artifacts.join(found, same, "left").select(*artifacts.columns, "__rule.rule_id", F.coalesce("__rule.target", F.lit(fallback)).alias("target"))
