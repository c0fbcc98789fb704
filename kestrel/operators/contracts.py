"""V1: JSON documents against contracts: required fields, types, values, ranges and no unknown keys, at any depth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How `schema_of_variant` begins for each kind of value.
BEGINNINGS = {"string": "STRING", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Rule:
    """What a value may be. ``fields`` are an object's, ``items`` an array's; an object that is not ``open`` has no other keys."""

    kind: str
    required: bool = False
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    date_time: bool = False
    fields: dict[str, Rule] = field(default_factory=dict)
    open: bool = False
    items: Rule | None = None


def broken(value: Column, rule: Rule, at: str = "") -> Column:
    """The rules that a variant breaks, as ``what:path`` (missing, unknown, type, value, range, time); a null column is a missing value.
    The value is bound to a name first, so that however many checks ask for it, it is taken out of its document once."""
    return F.transform(F.array(value), lambda v: _broken(v, rule, at))[0]


def _broken(value: Column, rule: Rule, at: str) -> Column:
    none = F.array().cast("array<string>")
    where = at or "document"

    def when(bad: Column, what: str) -> Column:
        return F.when(bad, F.array(F.lit(f"{what}:{where}"))).otherwise(none)

    checks = [none]
    if rule.allowed:
        checks.append(when(~F.try_variant_get(value, "$", "string").isin(*rule.allowed), "value"))
    if rule.low is not None or rule.high is not None:
        number = F.try_variant_get(value, "$", "double")
        within = [number >= rule.low] * (rule.low is not None) + [number <= rule.high] * (rule.high is not None)
        checks += [when(~F.coalesce(ok, F.lit(False)), "range") for ok in within]
    if rule.date_time:
        said = F.try_variant_get(value, "$", "string")
        checks.append(when(~said.rlike(DATE_TIME) | F.try_to_timestamp(said).isNull(), "time"))
    if rule.kind == "object":
        inside = f"{at}." if at else ""
        if not rule.open:
            keys = F.json_object_keys(F.to_json(value))
            other = F.array_except(keys, F.array(*map(F.lit, rule.fields)).cast("array<string>"))
            checks.append(F.transform(other, lambda k: F.concat(F.lit(f"unknown:{inside}"), k)))
        for name, own in rule.fields.items():
            checks.append(broken(F.try_variant_get(value, f"$.{name}", "variant"), own, f"{inside}{name}"))
    if rule.items is not None:
        own = F.try_variant_get(value, "$", "array<variant>")
        checks.append(F.flatten(F.transform(own, lambda x: broken(x, rule.items, f"{where}[]"))))
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.array(F.lit(f"missing:{where}")) if rule.required else none)
        .when(F.is_variant_null(value), none if rule.nullable else F.array(F.lit(f"type:{where}")))
        .when(~kind.rlike(f"^{BEGINNINGS[rule.kind]}"), F.array(F.lit(f"type:{where}")))
        .otherwise(F.coalesce(F.concat(*checks), none))
    )


def checked(df: DataFrame, contract: Rule, body: str = "body") -> DataFrame:
    """Append ``document`` (the body as a variant) and ``errors`` (the distinct rules it breaks, sorted) to rows of JSON texts.

    No shuffle and no Python; works on streams. A null or empty body, text that is no JSON and an object with one key twice have the error
    ``json``; a body that is no object breaks ``type:document``; repeated rows are judged alike; columns named ``document`` or ``errors`` are replaced.
    """
    read = df.withColumn("document", F.try_parse_json(F.col(f"`{body}`")))
    errors = F.when(F.col("document").isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.array_distinct(broken(F.col("document"), contract))))
    return read.withColumn("errors", errors)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of what ``checked`` gives."""
    return found.where(F.size("errors") == 0), found.where(F.size("errors") > 0)


#: The contract of a note event.
PLACE = Rule("object", nullable=True, open=True, fields={"district": Rule("string"), "lat": Rule("number"), "lon": Rule("number")})
FEATURES = ("security_thread", "microprint", "watermark", "latent_image", "see_through_register", "intaglio_print", "color_shifting_ink", "serial_number_font")
CHECK = Rule("object", fields={"name": Rule("string", True), "passed": Rule("boolean", True), "measurement": Rule("number"), "evidence": Rule("string", True)})
SIGHTING = Rule("object", fields={"event_id": Rule("string", True), "timestamp": Rule("string", True), "district": Rule("string", nullable=True)})
NOTE = Rule("object", True, fields={
    "schema_version": Rule("string", True, allowed=("1.0",)),
    "event_id": Rule("string", True),
    "timestamp": Rule("string", True, date_time=True),
    "denomination": Rule("string", True, allowed=("100", "200", "500", "2000", "unknown")),
    "verdict": Rule("string", True, allowed=("fake", "genuine", "uncertain")),
    "confidence": Rule("number", True, low=0, high=1),
    "missing_features": Rule("array", items=Rule("string", allowed=FEATURES)),
    "image_ref": Rule("string", nullable=True),
    "heatmap_ref": Rule("string", nullable=True),
    "location_hint": PLACE,
    "triage": Rule("object", nullable=True, fields={
        "decision": Rule("string", True, allowed=("pass", "obvious_fake", "unscannable")), "checks": Rule("array", True, items=CHECK),
        "narrative": Rule("string", nullable=True), "engine": Rule("string", nullable=True)}),
    "serial": Rule("object", nullable=True, fields={
        "value": Rule("string", True), "status": Rule("string", True, allowed=("valid", "suspicious", "nonsense", "duplicate")),
        "detail": Rule("string", True), "prior_sightings": Rule("array", items=SIGHTING)}),
    "vision_review": Rule("object", nullable=True, fields={
        "portrait_is_gandhi": Rule("boolean", nullable=True), "specimen_overprint": Rule("boolean", nullable=True), "header_correct": Rule("boolean", nullable=True),
        "observations": Rule("array", items=Rule("string")), "engine": Rule("string", True)}),
})
