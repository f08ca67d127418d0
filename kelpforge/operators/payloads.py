"""Payloads of extracted records: strict checks by the record's type and normalised fields before them, on JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V

# For each type its fields, in order, as (name, kind, required). A kind is text, number, flag, texts (a list of texts),
# the values that are allowed, or the fields of an object. Fields that are not required may be null, but for those in NOT_NULL.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
NODE_TYPES = ["Document", "Process", "Form", "Record", "Role"]
TYPES = {
    "service_price": [
        ("service_name", "text", True), ("price_amount", "number", True), ("currency", ["BRL"], False), ("price_type", ["fixed", "starting_from", "range", "unknown"], True), ("min_price", "number", False),
        ("max_price", "number", False), ("valid_from", "text", False), ("valid_until", "text", False),
    ],
    "business_hours": [("day_of_week", DAYS, True), ("open_time", "text", False), ("close_time", "text", False), ("is_closed", "flag", False), ("special_case", "text", False)],
    "payment_method": [("method", ["pix", "cash", "credit", "debit", "bank_transfer", "unknown"], True), ("accepted", "flag", True), ("conditions", "text", False)],
    "discount_rule": [
        ("condition", [("payment_method", "text", False), ("day_of_week", "text", False), ("min_value", "number", False)], True),
        ("action", [("discount_percentage", "number", False), ("discount_fixed", "number", False)], True),
    ],
    "cancellation_policy": [("notice_required_hours", "number", True), ("penalty_percentage", "number", False), ("penalty_fixed", "number", False)],
    "contact_info": [("phone", "text", False), ("email", "text", False), ("address", "text", False), ("website", "text", False), ("whatsapp", "text", False), ("contact_name", "text", False)],
    "faq_item": [("question", "text", True), ("answer", "text", True), ("category", "text", False)],
    "controlled_document_metadata": [
        ("document_code", "text", True), ("document_type", ["POP", "IT", "Manual", "Policy", "Form", "Record", "Specification"], True), ("title", "text", True), ("revision", "text", True),
        ("status", ["vigent", "obsolete", "draft", "approved", "unknown"], True), ("owner_area", "text", True), ("issue_date", "text", False), ("approval_date", "text", False), ("review_due_date", "text", False),
        ("process", "text", False), ("plant", "text", False), ("approvers", "texts", False), ("confidentiality", ["public", "internal", "restricted"], False), ("allowed_audience", "texts", False),
    ],
    "industrial_requirement": [
        ("requirement_type", ["procedure", "deadline", "acceptance_criteria", "mandatory_record", "approval", "training", "other"], True), ("subject", "text", True), ("requirement", "text", True), ("applies_to", "text", False),
    ],
    "industrial_responsibility": [("role", "text", True), ("responsibility", "text", True), ("process", "text", False), ("escalation", "text", False)],
    "industrial_relation": [
        ("from_id", "text", True), ("from_type", NODE_TYPES, True), ("to_id", "text", True), ("to_type", NODE_TYPES, True),
        ("relationship_type", ["defines_process", "uses_form", "requires_record", "assigns_responsibility", "requires_approval", "references_document", "supersedes", "is_revision_of", "triggers_action", "requires_training"], True),
        ("source_document_code", "text", False), ("evidence_quote", "text", False),
    ],
}
NOT_NULL = ["currency", "is_closed", "approvers", "allowed_audience"]
ALIASES = {
    "document_type": {
        "pop": "POP", "it": "IT", "manual": "Manual", "man": "Manual", "policy": "Policy", "politica": "Policy", "pol": "Policy", "form": "Form", "formulario": "Form", "for": "Form", "frm": "Form",
        "record": "Record", "registro": "Record", "reg": "Record", "specification": "Specification", "spec": "Specification", "esp": "Specification",
    },
    "status": {"vigente": "vigent", "vigent": "vigent", "aprovado": "approved", "approved": "approved", "obsoleto": "obsolete", "obsolete": "obsolete", "rascunho": "draft", "draft": "draft", "unknown": "unknown", "desconhecido": "unknown"},
    "confidentiality": {"publico": "public", "public": "public", "interno": "internal", "internal": "internal", "restrito": "restricted", "restricted": "restricted"},
}
FOLDED = ("çãáàâéêíóôõú", "caaaaeeiooou")
MONEY_FIELDS = {"service_price": ["price_amount", "min_price", "max_price"], "discount_rule": ["action.discount_fixed"], "cancellation_policy": ["penalty_fixed"]}
PERCENT_FIELDS = {"discount_rule": ["action.discount_percentage"], "cancellation_policy": ["penalty_percentage"]}
TIME_FIELDS = {"business_hours": ["open_time", "close_time"]}
#: At most so many errors of an edited rule are told.
SHOWN_ERRORS = 5


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _type(value: Column, path: str) -> Column:
    """The JSON type at a path: null where there is nothing, VOID of a null."""
    return F.schema_of_variant(_at(value, path))


def _fold(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), *FOLDED)


def _literal(value: Column, path: str) -> Column:
    """The text at a path, its aliases resolved."""
    text = _at(value, path, "string")
    names = ALIASES.get(path)
    if not names:
        return text
    key = F.lower(F.trim(text)) if path == "document_type" else _fold(text)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), text)


def _errors(value: Column, fields: list, path: str = "") -> list[Column]:
    """A column for each way in which the fields of an object can fail: null, or ``field: code``."""
    out = []
    for name, kind, required in fields:
        at = f"{path}{name}"
        found = _type(value, at)
        void = found == "VOID"
        null_ok = F.lit(not required and name not in NOT_NULL)
        bad = lambda code, ok: F.when(found.isNotNull() & ~ok & ~(void & null_ok), F.lit(f"{at}: {code}"))  # noqa: B023, E731
        if required:
            out.append(F.when(found.isNull(), F.lit(f"{at}: missing")))
        if kind == "text":
            out.append(bad("string_type", found == "STRING"))
        elif kind == "number":
            out.append(bad("float_type", found.rlike("^(BIGINT|DECIMAL|DOUBLE)")))
        elif kind == "flag":
            out.append(bad("bool_type", found == "BOOLEAN"))
        elif kind == "texts":
            out.append(bad("list_type", found.startswith("ARRAY")))
            out.append(F.when(found.startswith("ARRAY") & ~found.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"{at}: string_type")))
            out.append(F.when((found == "ARRAY<VOID>") & _at(value, f"{at}[0]").isNotNull(), F.lit(f"{at}: string_type")))
        elif isinstance(kind[0], tuple):
            is_object = found.startswith("OBJECT")
            out.append(bad("model_type", is_object))
            inner = _errors(value, kind, f"{at}.")
            out += [F.when(is_object, x) for x in inner]
        else:
            out.append(bad("literal_error", (found == "STRING") & F.coalesce(_literal(value, at).isin(kind), F.lit(False))))
    return out


def _extras(text: Column, fields: list, path: str = "") -> Column:
    """``field: extra_forbidden`` for each key that the type does not have."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.transform(F.array_except(keys, F.array(*[F.lit(f[0]) for f in fields])), lambda k: F.concat(F.lit(path), k, F.lit(": extra_forbidden")))


def errors(kind: Column, payload: Column) -> Column:
    """What is wrong with a JSON payload of a record's type, as ``field: code``; an empty list if it is valid.

    Nothing is converted: a number in a text is no number. Null text, text that is no JSON object (repeated keys included) and
    unknown types are one error each.
    """
    value = F.try_parse_json(payload)
    out = F.array(F.lit("fact_type: unknown"))
    for name, fields in TYPES.items():
        found = F.array_compact(F.array(*_errors(value, fields)))
        parts = [found, _extras(payload, fields)]
        parts += [_extras(F.get_json_object(payload, f"$.{f[0]}"), f[1], f"{f[0]}.") for f in fields if isinstance(f[1][0], tuple)]
        out = F.when(kind == name, F.concat(*parts)).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("payload: not_an_object"))).otherwise(out)


def normalised(kind: Column, payload: Column) -> Column:
    """The changed fields of a payload as a map from path to value text: sums, percentages and hours written as text, where they can be read.

    A path that is not in the map keeps its value; a text that cannot be read is left as it is.
    """
    value = F.try_parse_json(payload)
    pairs = []
    for fields, read in ((MONEY_FIELDS, V.money), (PERCENT_FIELDS, V.percent), (TIME_FIELDS, V.time_of_day)):
        for name, paths in fields.items():
            for path in paths:
                made = F.when((kind == name) & (_type(value, path) == "STRING"), read(_at(value, path, "string")).cast("string"))
                pairs.append(F.struct(F.lit(path).alias("key"), made.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def edit_errors(kind: Column, condition: Column, action: Column) -> Column:
    """The first errors of an edited rule: a discount has both parts, other types are one object of both, the action's keys later."""
    body = lambda x: F.regexp_extract(x, r"(?s)^\s*\{(.*)\}\s*$", 1)
    both = F.concat(F.lit('{"condition":'), F.coalesce(condition, F.lit("{}")), F.lit(',"action":'), F.coalesce(action, F.lit("{}")), F.lit("}"))
    merged = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(body(condition), F.lit("")), F.nullif(body(action), F.lit(""))), F.lit("}"))
    return F.slice(errors(kind, F.when(kind == "discount_rule", both).otherwise(merged)), 1, SHOWN_ERRORS)


def _shown(value: Column, text: Column) -> Column:
    """A JSON value, as variant and as text, as an answer shows it: texts bare, None, True and False, numbers; objects and arrays with
    their texts in single quotes."""
    kind = F.schema_of_variant(value)
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'  # of texts
    spaced = F.regexp_replace(text, "([,:])" + outside, "$1 ")
    for word, name in (("null", "None"), ("true", "True"), ("false", "False")):
        spaced = F.regexp_replace(spaced, rf"\b{word}\b" + outside, name)
    nested = F.translate(spaced, '"', "'")
    flag = F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", flag).when(kind.rlike("^(OBJECT|ARRAY)"), nested).otherwise(F.try_variant_get(value, "$", "string"))


def rendered(payload: Column, fallback: Column) -> Column:
    """A fact's text: its service and price, else all its fields in order, else the fallback.

    Of several names of service and price the first counts that says something: not empty, null, false or zero. A payload that
    is no object or has no fields falls back.
    """
    value, texts = F.try_parse_json(payload), F.from_json(payload, "map<string,string>")

    def said(*names: str) -> Column:
        shown = [_shown(_at(value, n), F.element_at(texts, n)) for n in names]
        return F.coalesce(*[F.when(~x.isin("", "None", "False", "0", "0.0", "{}", "[]"), x) for x in shown])

    service, price = said("service", "service_name", "name"), said("price", "price_amount")
    held = F.try_variant_get(value, "$", "map<string,variant>")
    listed = F.array_join(F.transform(F.json_object_keys(payload), lambda k: F.concat(k, F.lit(": "), _shown(F.element_at(held, k), F.element_at(texts, k)))), ", ")
    return F.when(service.isNotNull() & price.isNotNull(), F.concat(service, F.lit(": "), price)).when(F.size(held) > 0, listed).otherwise(fallback)
