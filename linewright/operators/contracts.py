"""Document contracts as rule tables.

Each rule is a SQL condition with the ``(code, path, message)`` it reports; a
document's errors are the rules that fire, in path order, and no row is dropped.
The same tables read raw JSON (as VARIANT, where a missing key, a null and a
wrong type differ) and typed structs (where only null, range and enumeration
faults remain). Every path is read once into a flat column before the rules run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright import fixed_values as fixed

SHA256 = "^[a-fA-F0-9]{64}$"
ERRORS_TYPE = "array<struct<code:string,path:string,message:string>>"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values: Sequence[str]) -> str:
    return f"{expr} IN ({', '.join(map(quoted, values))})"


_TOKENS = {
    "missing": ["MIS"], "null": ["VOI"], "string": ["STR"], "boolean": ["BOO"], "object": ["OBJ"],
    "array": ["ARR"], "number": ["BIG", "DEC", "DOU", "FLO"],
}


# ---- field access: every method returns SQL text -------------------------------------------------


class VariantDoc:
    """A parsed JSON document. Top-level documents stage what rules ask for as
    flat columns: every object is opened once, by one cast to a struct of the fields
    that rules name, and a field is taken from there; array elements (lambda
    variables) are read in place."""

    typed = False

    def __init__(self, column: str, *, staged: bool = True):
        self.column, self.staged = column, staged
        self.apart = f"_{column}_apart" if staged else None
        self.parts: dict[str, dict[str, None]] = {}
        self.kinds: dict[str, str] = {}
        self.values: dict[str, str] = {}

    def _keep(self, store: dict[str, str], tag: str, path: str, sql: str) -> str:
        if not self.staged:
            return f"({sql})"
        name = f"_{self.column}_{tag}_{path.replace('.', '_')}"
        store[name] = sql
        return name

    def stage(self, df: DataFrame) -> DataFrame:
        opened: dict[int, dict[str, str]] = {}
        for path, names in self.parts.items():
            fields = ",".join(f"`{n}`:variant" for n in names)
            opened.setdefault(path.count(".") + 1 if path else 0, {})[self._part(path)] = f"try_variant_get({self._field(path)}, '$', 'struct<{fields}>')"
        for depth in sorted(opened):
            df = df.withColumns({n: F.expr(s) for n, s in opened[depth].items()})
        kinds = {n: F.expr(self._kind(path)) for n, path in self.kinds.items()}
        df = df.withColumns(kinds | {self.apart: F.expr(f"exists(array({self.column} IS NULL), x -> x)")})
        return df.withColumns({n: F.expr(s) for n, s in self.values.items()} | {self.apart: F.expr(f"exists(array({self.apart}), x -> x)")})

    def _part(self, path: str) -> str:
        return f"_{self.column}_part_{path.replace('.', '_')}"

    def _field(self, path: str) -> str:
        """The VARIANT at a path of a staged document; NULL where the path is missing."""
        if not path:
            return self.column
        parent, _, name = path.rpartition(".")
        self._field(parent)
        self.parts.setdefault(parent, {})[name] = None
        return f"{self._part(parent)}.`{name}`"

    def _get(self, path: str, dtype: str) -> str:
        if self.staged:
            return self._field(path) if path and dtype == "variant" else f"try_variant_get({self._field(path)}, '$', '{dtype}')"
        return f"try_variant_get({self.column}, '{'$.' + path if path else '$'}', '{dtype}')"

    def _token(self, path: str) -> str:
        """First letters of the value's own type name; MIS for a missing path."""
        if not self.staged:
            return f"({self._kind(path)})"
        self._field(path)
        return self._keep(self.kinds, "kind", path, path)

    def _kind(self, path: str) -> str:
        kind = f"coalesce(substring(schema_of_variant({self._get(path, 'variant')}), 1, 3), 'MIS')"
        return f"CASE WHEN {self._part(path)} IS NOT NULL THEN 'OBJ' ELSE {kind} END" if path in self.parts else kind

    def is_kind(self, path: str, *kinds: str) -> str:
        return in_list(self._token(path), [t for k in kinds for t in _TOKENS[k]])

    def _value(self, tag: str, path: str, kind: str, dtype: str) -> str:
        return self._keep(self.values, tag, path, f"CASE WHEN {self.is_kind(path, kind)} THEN {self._get(path, dtype)} END")

    def text(self, path: str) -> str:
        return self._value("text", path, "string", "string")

    def number(self, path: str) -> str:
        return self._value("num", path, "number", "double")

    def flag(self, path: str) -> str:
        return self._value("flag", path, "boolean", "boolean")

    def items(self, path: str) -> str:
        return self._value("items", path, "array", "array<variant>")

    def unknown_keys(self, path: str, allowed: Sequence[str]) -> str | None:
        if not self.staged:
            known = ", ".join(map(quoted, allowed))
            return f"size(array_except(map_keys({self._get(path, 'map<string,variant>')}), array({known})))"
        # Only the number of keys is wanted; the map's values are a type that nothing is turned into.
        size = f"size({self._get(path, 'map<string,array<struct<`-`:variant>>>')})"
        known = " - ".join(f"int({self._field(f'{path}.{name}' if path else name)} IS NOT NULL)" for name in allowed)
        return self._keep(self.values, "extra", path, f"{size} - {known}")

    def distinct_items(self, path: str) -> str:
        return f"size(array_distinct(transform({self.items(path)}, x -> to_json(x))))"

    def element(self, variable: str) -> "VariantDoc":
        return VariantDoc(variable, staged=False)


class StructDoc:
    """A typed struct column; kinds follow from the schema, so only nulls are looked up."""

    typed = True
    _KINDS = {"string": "string", "double": "number", "bigint": "number", "boolean": "boolean"}

    def __init__(self, column: str, dtype: T.StructType):
        self.column, self.dtype = column, dtype
        self.apart = f"{column} IS NULL"

    def stage(self, df: DataFrame) -> DataFrame:
        return df

    def _type(self, path: str):
        dtype = self.dtype
        for part in [p for p in path.split(".") if p]:
            if not isinstance(dtype, T.StructType) or part not in dtype.names:
                return None
            dtype = dtype[part].dataType
        return dtype

    def _at(self, path: str) -> str:
        return f"{self.column}.{path}" if path else self.column

    def _is_line(self, path: str) -> bool:
        return path.split(".")[-1] == "line" and isinstance(self._type(path), T.StructType)

    def is_kind(self, path: str, *kinds: str) -> str:
        dtype = self._type(path)
        if dtype is None:
            return str("missing" in kinds).lower()
        if self._is_line(path):
            return in_list(f"coalesce({self._at(path)}.kind, 'null')", kinds)
        name = dtype.simpleString()
        known = "array" if name.startswith("array") else "object" if name.startswith("struct") else self._KINDS[name]
        if known in kinds:
            return "true" if "null" in kinds else f"({self._at(path)} IS NOT NULL)"
        return f"({self._at(path)} IS NULL)" if "null" in kinds else "false"

    def _typed(self, path: str, kinds, member: str, null: str) -> str:
        if self._is_line(path):
            return f"{self._at(path)}.{member}" if member else f"CAST(NULL AS {null})"
        return self._at(path) if isinstance(self._type(path), kinds) else f"CAST(NULL AS {null})"

    def text(self, path: str) -> str:
        return self._typed(path, T.StringType, "str", "STRING")

    def number(self, path: str) -> str:
        return self._typed(path, (T.DoubleType, T.LongType), "num", "DOUBLE")

    def flag(self, path: str) -> str:
        return self._typed(path, T.BooleanType, "", "BOOLEAN")

    def items(self, path: str) -> str:
        return self._at(path)

    def unknown_keys(self, path: str, allowed: Sequence[str]) -> str | None:
        return None

    def distinct_items(self, path: str) -> str:
        return f"size(array_distinct({self._at(path)}))"

    def element(self, variable: str) -> "StructDoc":
        element = StructDoc(variable, self._type("outcomes").elementType)
        element.apart = None
        return element


# ---- rules: (doc, path, guard) -> SQL texts, each a list of no or one error -----------------------
# Lists are joined by flatten, which Spark compiles; array_compact is a function of higher order, which it interprets with all inside.
# One such function beside the rules (``apart``: over an empty list here) keeps a projection out of whole-stage code. There all rules are
# one method, too long for the JVM to compile; outside they are split into short ones.

Rule = Callable[[object, str, str], list[str]]


def fires(condition: str, code: str, path: str, message: str) -> str:
    error = f"named_struct('code', {quoted(code)}, 'path', {quoted(path)}, 'message', {quoted(message)})"
    return f"CASE WHEN {condition} THEN CAST(array({error}) AS {ERRORS_TYPE}) ELSE CAST(array() AS {ERRORS_TYPE}) END"


def _breaks(condition: str, path: str, keyword: str, message: str) -> str:
    return fires(condition, f"schema.{path}.{keyword}", path, message)


def _wrong_type(doc, path: str, guard: str, *kinds: str) -> str:
    return _breaks(f"{guard} AND NOT {doc.is_kind(path, *kinds)}", path, "type", "value has the wrong type")


def a_string(*, min_length=0, pattern=None, enum=None, nullable=False, moment=False) -> Rule:
    def build(doc, path, guard):
        value = doc.text(path)
        if enum is not None:
            return [_breaks(f"{guard} AND NOT coalesce({in_list(value, enum)}, false)", path, "enum", "value is not one of the allowed values")]
        out = [_wrong_type(doc, path, guard, "string", *(["null"] if nullable else []))]
        if min_length:
            out.append(_breaks(f"{guard} AND length({value}) < {min_length}", path, "minLength", "text is too short"))
        if pattern:
            out.append(_breaks(f"{guard} AND NOT {value} RLIKE {quoted(pattern)}", path, "pattern", "text does not match the pattern"))
        if moment:
            zoned = f"{value} RLIKE {quoted(ZONED)} AND try_to_timestamp({value}) IS NOT NULL"
            out.append(_breaks(f"{guard} AND {value} IS NOT NULL AND NOT ({zoned})", path, "format", "not a timestamp with a zone"))
        return out

    return build


ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def a_const(value) -> Rule:
    def build(doc, path, guard):
        if isinstance(value, bool):
            same = f"{doc.flag(path)} = {str(value).lower()}"
        elif isinstance(value, str):
            same = f"{doc.text(path)} = {quoted(value)}"
        else:
            same = f"{doc.number(path)} = {value}"
        return [_breaks(f"{guard} AND NOT coalesce({same}, false)", path, "const", "value differs from the required constant")]

    return build


def a_boolean(*, nullable=False) -> Rule:
    return lambda doc, path, guard: [_wrong_type(doc, path, guard, "boolean", *(["null"] if nullable else []))]


def a_number(*, above=None, below=None, minimum=None, maximum=None, integer=False, nullable=False, or_null=False) -> Rule:
    """``or_null`` reports any fault as one failed choice between null and a number in range."""

    def build(doc, path, guard):
        value = doc.number(path)
        bounds = []
        for keyword, limit, sign in (
            ("minimum", minimum, "<"), ("exclusiveMinimum", above, "<="),
            ("maximum", maximum, ">"), ("exclusiveMaximum", below, ">="),
        ):
            if limit is not None:
                bounds.append((keyword, f"{value} {sign} {limit}"))
        if or_null:
            outside = " OR ".join(f"coalesce({test}, false)" for _, test in bounds)
            bad = f"NOT {doc.is_kind(path, 'number', 'null')} OR {outside}"
            return [_breaks(f"{guard} AND ({bad})", path, "oneOf", "neither null nor a number in range")]
        out = [_wrong_type(doc, path, guard, "number", *(["null"] if nullable else []))]
        if integer:
            out.append(_breaks(f"{guard} AND {value} <> floor({value})", path, "type", "value has the wrong type"))
        return out + [_breaks(f"{guard} AND {test}", path, keyword, "number is out of range") for keyword, test in bounds]

    return build


def a_line() -> Rule:
    return lambda doc, path, guard: [_wrong_type(doc, path, guard, "number", "string", "null")]


def an_object(fields: dict[str, Rule], optional: Sequence[str] = (), extra: dict[str, Rule] | None = None) -> Rule:
    """Closed object: unknown keys, missing keys, then its fields in name order.

    ``extra`` holds further rules on a field (the conditional parts of a contract).
    """

    def build(doc, path, guard):
        shown = path or "$"
        out, inside = [], guard
        if path:
            out.append(_wrong_type(doc, path, guard, "object"))
            inside = f"{guard} AND {doc.is_kind(path, 'object')}"
        unknown = doc.unknown_keys(path, list(fields))
        if unknown:
            out.append(_breaks(f"{inside} AND {unknown} > 0", shown, "additionalProperties", "object has unknown fields"))
        full = {name: f"{path}.{name}" if path else name for name in fields}
        for name in fields:
            if name not in optional:
                out.append(_breaks(f"{inside} AND {doc.is_kind(full[name], 'missing')}", shown, "required", f"{name} is missing"))
        for name in sorted(fields):
            absent = ["missing", "null"] if doc.typed and name in optional else ["missing"]
            present = f"{inside} AND NOT {doc.is_kind(full[name], *absent)}"
            out += fields[name](doc, full[name], present)
            if extra and name in extra:
                out += extra[name](doc, full[name], present)
        return out

    return build


def a_status_list(allowed: Sequence[str]) -> Rule:
    def build(doc, path, guard):
        items = doc.items(path)
        text = "x" if doc.typed else "try_variant_get(x, '$', 'string')"
        bad = f"exists({items}, x -> NOT coalesce({in_list(text, allowed)}, false))"
        return [
            _wrong_type(doc, path, guard, "array"),
            _breaks(f"{guard} AND size({items}) < 1", path, "minItems", "list is too short"),
            _breaks(f"{guard} AND {doc.distinct_items(path)} < size({items})", path, "uniqueItems", "list repeats an item"),
            _breaks(f"{guard} AND {bad}", f"{path}.items", "enum", "an item is not one of the allowed values"),
        ]

    return build


def outcome_list(doc, path: str, guard: str) -> list[str]:
    items = doc.items(path)
    return [
        _wrong_type(doc, path, guard, "array"),
        _breaks(f"{guard} AND size({items}) < 2", path, "minItems", "list is too short"),
        _breaks(f"{guard} AND {doc.distinct_items(path)} < size({items})", path, "uniqueItems", "list repeats an item"),
    ]


def _outcome_errors(doc) -> str:
    """Errors inside the outcome list, under ``outcomes.<index>``."""
    inner = doc.element("x")
    fields = {"selection": _NAME, "decimal_odds": a_number(above=1)}
    is_object = inner.is_kind("", "object")
    rules = [_wrong_type(inner, "", "true", "object")]
    unknown = inner.unknown_keys("", list(fields))
    if unknown:
        rules.append(_breaks(f"{is_object} AND {unknown} > 0", "", "additionalProperties", "object has unknown fields"))
    for name in fields:
        rules.append(_breaks(f"{is_object} AND {inner.is_kind(name, 'missing')}", "", "required", f"{name} is missing"))
    for name in sorted(fields):
        rules += fields[name](inner, name, f"{is_object} AND NOT {inner.is_kind(name, 'missing')}")
    placed = (
        "named_struct('code', concat('schema.outcomes.', i, substring(replace(e.code, 'schema..', 'schema.'), 7)), "
        "'path', concat_ws('.', 'outcomes', i, nullif(e.path, '')), 'message', e.message)"
    )
    return f"coalesce(flatten(transform({doc.items('outcomes')}, (x, i) -> transform({collect(inner, rules)}, e -> {placed}))), array())"


def collect(doc, rules: Sequence[str], dtype: str = ERRORS_TYPE) -> str:
    joined = f"flatten(array({', '.join(rules)}))"
    return f"concat({joined}, filter(CAST(array() AS {dtype}), x -> {doc.apart}))" if doc.apart else joined


def _when_status(status: str, rule: Rule) -> Rule:
    return lambda doc, path, guard: rule(doc, path, f"{guard} AND {doc.text('calibration_status')} <=> {quoted(status)}")


def _all_of(*rules: Rule) -> Rule:
    return lambda doc, path, guard: [e for rule in rules for e in rule(doc, path, guard)]


def _not_none(doc, path: str, guard: str) -> list[str]:
    return [_breaks(f"{guard} AND {doc.text(path)} = 'none'", path, "not", "method may not be none")]


_NAME = a_string(min_length=1)
_SPORT = a_string(enum=fixed.SPORTS)
_MOMENT = a_string(moment=True)
_SHARE = a_number(minimum=0, maximum=1)
_AMOUNT = a_number(minimum=0)
_PROBABILITY = a_number(above=0, below=1)
_DOMAIN = {f: _NAME for f in fixed.DOMAIN_FIELDS} | {"sport": _SPORT, "line": a_line()}


def model_output(doc, namespace: str = fixed.NAMESPACE) -> str:
    fields = {
        "schema_version": a_const(f"{namespace}.model-output.v1"),
        "event_id": _NAME, "market_id": _NAME, "model_name": _NAME, "model_version": _NAME,
        **_DOMAIN, "selection": _NAME,
        "probability_raw": _PROBABILITY,
        "probability_calibrated": a_number(above=0, below=1, or_null=True),
        "calibration_status": a_string(enum=fixed.CALIBRATION_STATUSES),
        "calibration_method": a_string(enum=fixed.CALIBRATION_METHODS),
        "prediction_generated_at": _MOMENT, "feature_cutoff_at": _MOMENT, "training_cutoff_at": _MOMENT,
        "feature_schema_version": _NAME,
        "validation_domain": an_object(_DOMAIN),
        "validation_window": a_string(nullable=True),
        "validation_sample_size": a_number(minimum=1, integer=True, nullable=True),
        "brier_score": a_number(minimum=0, maximum=1, or_null=True),
        "log_loss": a_number(minimum=0, or_null=True),
        "expected_calibration_error": a_number(minimum=0, maximum=1, or_null=True),
        "training_data_version": _NAME,
        "model_artifact_sha256": a_string(pattern=SHA256),
        "calibration_artifact_sha256": a_string(pattern=SHA256),
        "notes": a_string(),
    }
    evidence = {
        "probability_calibrated": _PROBABILITY, "calibration_method": _not_none,
        "validation_window": a_string(min_length=1),
        "validation_sample_size": a_number(minimum=1, integer=True),
        "brier_score": _SHARE, "log_loss": _AMOUNT, "expected_calibration_error": _SHARE,
    }
    extra = {name: _when_status("validated", rule) for name, rule in evidence.items()}
    extra["calibration_method"] = _all_of(extra["calibration_method"], _when_status("uncalibrated", a_const("none")))
    optional = ["training_data_version", "model_artifact_sha256", "calibration_artifact_sha256", "notes"]
    return collect(doc, an_object(fields, optional, extra)(doc, "", "true"))


def market_snapshot(doc, namespace: str = fixed.NAMESPACE) -> str:
    fields = {
        "schema_version": a_const(f"{namespace}.market-snapshot.v1"),
        "event_id": _NAME, "market_id": _NAME, "book": _NAME, "book_market_id": _NAME,
        "captured_at": _MOMENT, "event_start_at": _MOMENT, **_DOMAIN, "selection": _NAME,
        "decimal_odds": a_number(above=1), "market_status": a_string(enum=fixed.MARKET_STATUSES),
        "is_complete": a_const(True), "outcomes": outcome_list,
        "correlation_group": a_string(min_length=1, nullable=True), "source": _NAME, "source_url": a_string(),
    }
    optional = ["book_market_id", "correlation_group", "source", "source_url"]
    rules = an_object(fields, optional)(doc, "", "true")
    # The list's element errors belong right after the errors of the list itself.
    behind = sum(len(fields[n](doc, n, "true")) for n in fields if n > "outcomes")
    cut = len(rules) - behind
    return f"concat({collect(doc, rules[:cut])}, {_outcome_errors(doc)}, {collect(doc, rules[cut:])})"


def portfolio_state(doc, namespace: str = fixed.NAMESPACE) -> str:
    exposures = ["open_amount", "daily_turnover_amount", "league_amount", "rolling_3d_turnover_amount", "correlation_group_amount"]
    fields = {
        "schema_version": a_const(f"{namespace}.portfolio-state.v1"),
        "portfolio_id": _NAME, "captured_at": _MOMENT, "currency": a_string(pattern="^[A-Z]{3}$"),
        "bankroll": a_number(above=0), "available_balance": _AMOUNT, "stake_increment": a_number(above=0),
        "league": _NAME, "correlation_group": a_string(nullable=True), "drawdown_fraction": _SHARE,
        "open_positions_count": a_number(minimum=0, integer=True),
        "exposures": an_object({e: _AMOUNT for e in exposures}),
    }
    return collect(doc, an_object(fields)(doc, "", "true"))


def risk_policy(doc, namespace: str = fixed.NAMESPACE) -> str:
    """Contract rules plus the order warning <= review <= pause."""
    tiers = an_object({"validated": _SHARE, "uncalibrated": _SHARE, "unknown": a_const(0)})
    caps = [
        "max_stake_fraction_per_bet", "max_open_exposure_fraction", "max_daily_turnover_fraction",
        "max_league_exposure_fraction", "max_rolling_3d_turnover_fraction", "max_correlation_group_fraction",
    ]
    ages = ["market_snapshot", "portfolio_state", "model_output", "mlb_context"]
    levels = ["warning_fraction", "review_fraction", "pause_fraction"]
    fields = {
        "schema_version": a_const(f"{namespace}.risk-policy.v1"),
        "policy_id": _NAME, "policy_version": _NAME, "minimum_ev": _AMOUNT,
        "minimum_edge_probability_points": _SHARE, "minimum_stake": _AMOUNT,
        "allowed_calibration_statuses": a_status_list(["validated", "uncalibrated"]),
        "kelly_fraction": tiers, "sizing_model_weight": tiers,
        "caps": an_object({c: _SHARE for c in caps}),
        "freshness_seconds": an_object({a: a_number(minimum=1, integer=True) for a in ages}),
        "drawdown": an_object({level: _SHARE for level in levels}),
        "human_approval_required": a_const(True), "block_unknown_correlation": a_boolean(),
    }
    warn, review, pause = (doc.number(f"drawdown.{level}") for level in levels)
    disorder = fires(
        f"NOT ({warn} <= {review} AND {review} <= {pause})", "drawdown.order", "drawdown",
        "drawdown must satisfy warning <= review <= pause",
    )
    return collect(doc, [*an_object(fields)(doc, "", "true"), disorder])


def mlb_context(doc, namespace: str = fixed.NAMESPACE) -> str:
    starter = an_object({"name": a_string(nullable=True), "status": a_string(enum=fixed.STARTER_STATUSES)})
    lineup, bullpen = a_string(enum=fixed.LINEUP_STATUSES), a_string(enum=fixed.BULLPEN_STATUSES)
    tri = a_boolean(nullable=True)
    needs = [
        "requires_confirmed_starters", "requires_lineup_compatibility", "requires_bullpen_state",
        "uses_roof", "uses_weather", "uses_umpire",
    ]
    fields = {
        "schema_version": a_const(f"{namespace}.mlb-context.v1"), "event_id": _NAME, "captured_at": _MOMENT,
        "settlement": an_object({"pitcher_rule": a_string(enum=fixed.PITCHER_RULES), "listed_pitchers_match": tri}),
        "starters": an_object({"home": starter, "away": starter}),
        "lineups": an_object({"home": lineup, "away": lineup}),
        "bullpen": an_object({"home": bullpen, "away": bullpen}),
        "environment": an_object({"roof_matches_model": tri, "weather_matches_model": tri, "umpire_matches_model": tri}),
        "model_dependencies": an_object({n: a_boolean() for n in needs}),
    }
    return collect(doc, an_object(fields)(doc, "", "true"))


def human_review(doc) -> str:
    fields = {
        "review_id": _NAME, "packet_sha256": a_string(pattern=SHA256), "prediction_id": _NAME,
        "model_version": _NAME, "reviewed_at": _MOMENT,
        "system_decision": a_string(enum=fixed.DECISIONS), "human_decision": a_string(enum=fixed.HUMAN_DECISIONS),
        "model_probability_changed": a_const(False), "proposed_stake": _AMOUNT, "approved_stake": _AMOUNT,
        "reason": _NAME, "notes": a_string(),
    }
    return collect(doc, an_object(fields, ["notes"])(doc, "", "true"))


def comparable(doc, path: str) -> str:
    """A value with its kind: 8 and "8" differ, 8 and 8.0 agree, missing equals null."""
    return f"named_struct('kind', {line_kind(doc, path)}, 'num', {doc.number(path)}, 'str', {doc.text(path)})"


def line_kind(doc, path: str) -> str:
    return (
        f"CASE WHEN {doc.is_kind(path, 'number')} THEN 'number' WHEN {doc.is_kind(path, 'string')} THEN 'string' "
        f"WHEN {doc.is_kind(path, 'null', 'missing')} THEN 'null' ELSE 'other' END"
    )


def domain_match(doc) -> str:
    """Prediction target against its own validation domain; skipped if not an object."""
    return collect(doc, [
        fires(
            f"{doc.is_kind('validation_domain', 'object')} AND NOT "
            f"({comparable(doc, name)} <=> {comparable(doc, f'validation_domain.{name}')})",
            f"domain_mismatch.{name}", f"validation_domain.{name}",
            "validation domain differs from the prediction target",
        )
        for name in fixed.DOMAIN_FIELDS
    ])


# ---- DataFrame jobs --------------------------------------------------------------------------------


def document_of(df: DataFrame, document: str):
    dtype = df.schema[document].dataType
    return StructDoc(document, dtype) if isinstance(dtype, T.StructType) else VariantDoc(document)


def contract_errors(df: DataFrame, document: str, rules: Callable[..., str], out: str = "errors", **options) -> DataFrame:
    """Add the error array of a VARIANT or typed struct column."""
    doc = document_of(df, document)
    errors = rules(doc, **options)
    return doc.stage(df).withColumn(out, F.expr(errors)).select(*[c for c in df.columns if c != out], out)


def model_verdict(df: DataFrame, document: str, namespace: str = fixed.NAMESPACE) -> DataFrame:
    """Add ``errors``, ``decision``, ``valid`` and ``domain_match`` for a model document."""
    doc = document_of(df, document)
    status = doc.text("calibration_status")
    contract, domain = model_output(doc, namespace), domain_match(doc)
    unknown = collect(doc, [fires(
        f"{status} = 'unknown'", "calibration_status.unknown", "calibration_status",
        "unknown calibration provenance is blocked from staking",
    )])
    decision = (
        F.when(F.size("errors") > 0, "BLOCKED").when(F.col("_status") == "validated", "VALIDATED")
        .when(F.col("_status") == "uncalibrated", "UNCALIBRATED").otherwise("BLOCKED")
    )
    return (
        doc.stage(df)
        .withColumns({"_contract": F.expr(contract), "_domain": F.expr(domain), "_unknown": F.expr(unknown), "_status": F.expr(status)})
        .withColumn("errors", F.concat("_contract", "_domain", "_unknown"))
        .withColumn("decision", decision)
        .withColumn("valid", F.col("decision").isin("VALIDATED", "UNCALIBRATED"))
        .withColumn("domain_match", F.size("_domain") == 0)
        .select(*df.columns, "errors", "decision", "valid", "domain_match")
    )


def typed_document(df: DataFrame, document: str, dtype: T.StructType, out: str) -> DataFrame:
    """Project a VARIANT document to its row type; a value of the wrong type is NULL."""
    doc = VariantDoc(document)
    row = _typed_row(doc, dtype, "")
    return doc.stage(df).withColumn(out, F.expr(row)).select(*[c for c in df.columns if c != out], out)


def _typed_row(doc: VariantDoc, dtype: T.StructType, path: str) -> str:
    parts = []
    for field in dtype:
        full = f"{path}.{field.name}" if path else field.name
        kind = field.dataType
        if field.name == "line" and isinstance(kind, T.StructType):
            value = (
                f"named_struct('kind', if({doc.is_kind(full, 'number', 'string')}, {line_kind(doc, full)}, 'null'), "
                f"'num', {doc.number(full)}, 'str', {doc.text(full)})"
            )
        elif isinstance(kind, T.StructType):
            value = f"CASE WHEN {doc.is_kind(full, 'object')} THEN {_typed_row(doc, kind, full)} END"
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            value = f"transform({doc.items(full)}, x -> {_typed_row(doc.element('x'), kind.elementType, '')})"
        elif isinstance(kind, T.ArrayType):
            value = f"transform({doc.items(full)}, x -> try_variant_get(x, '$', 'string'))"
        elif isinstance(kind, T.StringType):
            value = doc.text(full)
        elif isinstance(kind, T.BooleanType):
            value = doc.flag(full)
        elif isinstance(kind, T.LongType):
            value = f"CAST({doc.number(full)} AS BIGINT)"
        else:
            value = doc.number(full)
        parts.append(f"'{field.name}', {value}")
    return f"named_struct({', '.join(parts)})"


# ---- lighter snapshot checks -----------------------------------------------------------------------


def _code(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN array({quoted(text)}) ELSE CAST(array() AS array<string>) END"


def _codes(doc, rules: Sequence[str]) -> str:
    return collect(doc, rules, "array<string>")


def _readable(value: str) -> str:
    bare = f"if(length({value}) = 10, concat({value}, 'T00:00:00Z'), {value})"
    return f"({value} RLIKE {quoted(_ISO)} AND try_to_timestamp({bare}) IS NOT NULL)"


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def minimum_snapshot(doc: VariantDoc) -> str:
    """Required keys, price, probability, timestamps and outcome count; ``event`` falls back to the root."""
    nested = f"NOT {doc.is_kind('event', 'missing')}"
    out = [
        _code(f"if({nested}, {doc.is_kind('event.' + f, 'missing')}, {doc.is_kind(f, 'missing')})", f"missing_event.{f}")
        for f in fixed.SNAPSHOT_EVENT_REQUIRED
    ]
    for part, fields in (("market", fixed.SNAPSHOT_MARKET_REQUIRED), ("model", fixed.SNAPSHOT_MODEL_REQUIRED)):
        out += [_code(doc.is_kind(f"{part}.{f}", "missing"), f"missing_{part}.{f}") for f in fields]
    odds, p = doc.number("market.odds_decimal"), doc.number("model.probability_calibrated")
    out.append(_code(f"NOT coalesce({odds} > 1, false)", "invalid_market.odds_decimal"))
    out.append(_code(f"NOT coalesce({p} > 0 AND {p} < 1, false)", "invalid_model.probability_calibrated"))
    empty = lambda path: doc.is_kind(path, "missing", "null")
    start = (
        f"if({nested}, {empty('event.event_start_at')}, {empty('event_start_at')})",
        f"if({nested}, {doc.text('event.event_start_at')}, {doc.text('event_start_at')})",
    )
    moments = {"event.event_start_at": start} | {
        path: (empty(path), doc.text(path)) for path in ("market.snapshot_at", "model.prediction_generated_at")
    }
    for shown, (absent, value) in moments.items():
        out.append(_code(f"NOT {absent} AND NOT coalesce({_readable(value)}, false)", f"invalid_timestamp.{shown}"))
    out.append(_code(f"coalesce(size({doc.items('market.outcomes')}), 0) < 2", "invalid_market.outcomes"))
    return _codes(doc, out)


def packet_market(doc: VariantDoc) -> str:
    """Market side of a review packet."""
    out = [_code(doc.is_kind(f"event.{f}", "missing"), f"packet.missing.event.{f}") for f in fixed.PACKET_EVENT_REQUIRED]
    out += [_code(doc.is_kind(f"market.{f}", "missing"), f"packet.missing.market.{f}") for f in fixed.PACKET_MARKET_REQUIRED]
    pair = f"coalesce(size({doc.items('event.participants')}), -1)"
    out.append(_code(f"{pair} <> 2", "packet.participants.two"))
    out.append(_code(f"NOT coalesce({doc.number('market.odds_decimal')} > 1, false)", "packet.odds.above_one"))
    out.append(_code(f"coalesce(size({doc.items('market.outcomes')}), 0) < 2", "packet.outcomes.two"))
    agrees = f"({comparable(doc, 'event_id')} <=> {comparable(doc, 'event.event_id')})"
    out.append(_code(
        f"NOT {doc.is_kind('event_id', 'missing')} AND NOT {agrees}",
        "packet.event_id.conflict",
    ))
    return (
        f"CASE WHEN NOT {doc.is_kind('event', 'object')} THEN array('packet.event.object') "
        f"WHEN NOT {doc.is_kind('market', 'object')} THEN array('packet.market.object') ELSE {_codes(doc, out)} END"
    )
