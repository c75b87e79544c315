"""Text and JSON rules as column expressions, so a whole table is one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from layover.functions import wording
from layover.functions.outcome import present, stripped

FLIGHT_CODE = r"EK\d{3}"
LIMIT_PHRASE = r"(?i)cannot land after (\d{1,2})\s*(AM|PM)"
QUIET_PHRASE = r"(?i)quiet (place|work|pod|space)"
LOUNGE_PHRASE = r"(?i)lounge"
PROFILE_LINE = r"^\s*[-•*]?\s*([^:]+):\s*(.+)\z"
# What counts as an object in an agent's answer.
FENCED_OBJECT = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
BARE_OBJECT = r"(?s)(\{[^{}]*\"chosen_flight\"[^{}]*\})"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed a single time, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


# --- phrases and flights -------------------------------------------------------------------


def mentions_any(text: Column, phrases: list[str]) -> Column:
    """True when any phrase occurs in the text, ignoring case; NULL text mentions nothing."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = lowered.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | lowered.contains(phrase)
    return found


def changes_mind(text: Column) -> Column:
    return mentions_any(text, wording.CHANGE_OF_MIND)


def claims_cancellation(text: Column) -> Column:
    return mentions_any(text, wording.CANCELLATION_CLAIMS)


def offered_flight(text: Column) -> Column:
    """The later flight when it is the only one of the two named, else the early one."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    only_later = upper.contains(wording.LATER_FLIGHT) & ~upper.contains(wording.EARLY_FLIGHT)
    return F.when(only_later, wording.LATER_FLIGHT).otherwise(wording.EARLY_FLIGHT)


def first_flight_code(text: Column) -> Column:
    """First flight code anywhere in the text, NULL when there is none."""
    return present(F.regexp_extract(F.upper(text), FLIGHT_CODE, 0))


def flight_list(text: Column) -> Column:
    """Comma list to an array of trimmed, non-empty codes; NULL text gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), stripped)
    return F.filter(parts, lambda p: p != "")


# --- constraints in chat -------------------------------------------------------------------


def limit_hour(text: Column) -> Column:
    """Latest landing hour stated in the text, on a 24 hour clock, or NULL."""
    hour = present(F.regexp_extract(text, LIMIT_PHRASE, 1)).cast("int")
    evening = F.upper(F.regexp_extract(text, LIMIT_PHRASE, 2)) == "PM"
    return F.when(evening, hour % 12 + 12).otherwise(hour % 12)


def wants_quiet(text: Column) -> Column:
    return F.coalesce(text.rlike(QUIET_PHRASE), F.lit(False))


def wants_lounge(text: Column) -> Column:
    return F.coalesce(text.rlike(LOUNGE_PHRASE), F.lit(False))


# --- profile text --------------------------------------------------------------------------


def profile_fields(text: Column) -> Column:
    """``Field: value`` lines as a map; the last line wins when a field repeats."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(PROFILE_LINE))
    pairs = F.reverse(
        F.transform(
            lines,
            lambda line: F.struct(
                stripped(F.regexp_extract(line, PROFILE_LINE, 1)).alias("key"),
                stripped(F.regexp_extract(line, PROFILE_LINE, 2)).alias("value"),
            ),
        )
    )

    def newest(found: Column) -> Column:
        return once(
            F.transform(found, lambda p: p["key"]),
            lambda keys: F.filter(found, lambda p, i: F.array_position(keys, p["key"]) == i + 1),
        )

    return F.map_from_entries(once(pairs, newest))


def grouped_number(text: Column) -> Column:
    """Number with thousands commas and up to three decimals, without trailing zeros."""
    return F.regexp_replace(F.format_number(text.try_cast("double"), 3), r"\.?0+$", "")


def highlight_label(field: Column) -> Column:
    """Label a profile field is shown under, NULL for fields that are not shown."""
    labels = [x for label, name in wording.PROFILE_HIGHLIGHTS for x in (F.lit(name), F.lit(label))]
    return F.try_element_at(F.create_map(*labels), field)


def highlight_value(label: Column, value: Column) -> Column:
    """Value as shown: spend as a dollar amount, everything else as it is."""
    dollars = F.concat(F.lit("$"), F.coalesce(grouped_number(value), F.lit("NaN")))
    return F.when(label == "Spend", dollars).otherwise(value)


# --- JSON ----------------------------------------------------------------------------------


END_MARK = "__end_of_text"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_fields(text: Column, *fields: str) -> Column:
    """Struct of the named fields as text, or NULL unless the text is exactly one JSON object.

    The text is parsed once, as the first of two list elements.  Anything after its value then
    breaks the list, ends it early or adds to it, and the end mark is not found in second place;
    it holds a hash of the text, so a text cannot bring its own.
    Lists and objects come back as JSON text.
    """
    own = F.xxhash64(text).cast("string")
    schema = "array<struct<" + ",".join(f"{f}:string" for f in (*fields, END_MARK)) + ">>"
    marked = F.concat(F.lit("["), text, F.lit(f',{{"{END_MARK}":"'), own, F.lit('"}]'))
    parsed = F.from_json(marked, schema, STRICT_JSON)

    def alone(found: Column) -> Column:
        whole = (F.size(found) == 2) & (found[1][END_MARK] == own) & found[0].isNotNull()
        return F.when(whole, F.struct(*[found[0][f].alias(f) for f in fields]))

    return once(parsed, alone)


def document(text: Column) -> Column:
    """The text as a VARIANT, NULL unless it is exactly one JSON object; to be stored and read by path.

    Numbers are kept as values, not as written: ``1.0`` is 1.  A text with a repeated field is no document.
    The text is parsed as the first of two list elements, so that nothing may follow its object; the second
    is a hash of the text, so a text cannot bring its own.
    """
    own = F.xxhash64(text).cast("string")
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), own, F.lit('"]')))

    def alone(found: Column) -> Column:
        first = F.try_variant_get(found, "$[0]", "variant")
        whole = (F.try_variant_get(found, "$[1]", "string") == own) & F.try_variant_get(found, "$[2]", "variant").isNull()
        return F.when(whole & F.schema_of_variant(first).startswith("OBJECT"), first)

    return once(parsed, alone)


def document_text(doc: Column, field: str) -> Column:
    """A field of a document as text; lists and objects as JSON, a JSON null or no such field as NULL."""
    return F.try_variant_get(doc, f"$.{field}", "string")


def document_summary(doc: Column, reasoning: Column) -> Column:
    """``audit_summary`` from a document that was parsed before, beside its text."""
    plain = F.coalesce(reasoning, F.lit(""))

    def part(label: str, field: str) -> Column:
        return F.concat(F.lit(label), present(document_text(doc, field)))

    held = present(document_text(doc, "held_flights"))
    flights = F.try_variant_get(doc, "$.held_flights", "array<string>")
    shown = F.concat_ws(
        " · ",
        part("Segment: ", "archetype"),
        F.when(held.isNotNull(), F.concat(F.lit("Held: "), F.array_join(flights, ", ", ""))),
        part("Chosen: ", "chosen_flight"),
        part("Handoff: ", "handoff"),
    )
    held_is_no_list = F.coalesce(~held.startswith("["), F.lit(False))
    return F.when(doc.isNull() | held_is_no_list | (shown == ""), plain).otherwise(shown)


def audit_summary(reasoning: Column) -> Column:
    """One-line summary of a reasoning document; other text is shown as it is, NULL as ''."""
    plain = F.coalesce(reasoning, F.lit(""))

    def summary(document: Column) -> Column:
        def part(label: str, field: str) -> Column:
            value = present(document[field])
            return F.when(value.isNotNull(), F.concat(F.lit(label), value))

        held_text = present(document["held_flights"])
        held = F.from_json(held_text, "array<string>")
        shown = F.concat_ws(
            " · ",
            part("Segment: ", "archetype"),
            F.when(held_text.isNotNull(), F.concat(F.lit("Held: "), F.array_join(held, ", ", ""))),
            part("Chosen: ", "chosen_flight"),
            part("Handoff: ", "handoff"),
        )
        held_is_no_list = F.coalesce(~held_text.startswith("["), F.lit(False))
        return F.when(
            document.isNull() | held_is_no_list | (shown == ""), plain
        ).otherwise(shown)

    return once(json_fields(reasoning, "archetype", "held_flights", "chosen_flight", "handoff"), summary)


def as_json(**fields: Column) -> Column:
    """JSON object text with every field written, NULL included, in the order given."""
    struct = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(struct, {"ignoreNullFields": "false"})


def staging_reasoning(archetype: Column, flights: Column) -> Column:
    return as_json(
        archetype=archetype,
        held_flights=flights,
        push_prompt=F.lit(wording.PUSH_PROMPT),
        handoff=F.lit(wording.HANDOFF),
    )


def decision_from_text(text: Column) -> Column:
    """Decision struct out of free text.

    Fenced objects come first, then bare objects naming a flight; the first one that is valid
    JSON with a flight is used.  Without one, the flight is guessed from the text and the first
    600 characters become the reason.
    """
    body = F.coalesce(text, F.lit(""))
    candidates = F.concat(
        F.regexp_extract_all(body, F.lit(FENCED_OBJECT), F.lit(1)),
        F.regexp_extract_all(body, F.lit(BARE_OBJECT), F.lit(1)),
    )
    parsed = F.filter(
        F.transform(candidates, lambda c: json_fields(c, *wording.DECISION_FIELDS)),
        lambda d: present(d["chosen_flight"]).isNotNull(),
    )
    empty = F.lit(None).cast("string")
    guess = {
        "chosen_flight": offered_flight(body),
        "reasoning_summary": F.substring(body, 1, wording.RAW_TEXT_CHARS),
    }
    guessed = F.struct(
        *[guess.get(f, empty).alias(f) for f in wording.DECISION_FIELDS]
    )
    return F.coalesce(F.try_element_at(parsed, F.lit(1)), guessed)


def transcript_line(role: Column, text: Column, message: Column | None = None) -> Column:
    """``[ROLE]: text``; a missing role is the passenger, missing text falls back to message."""
    speaker = F.upper(F.coalesce(role, F.lit("passenger")))
    fallback = message if message is not None else F.lit(None).cast("string")
    said = F.coalesce(present(text), present(fallback), F.lit(""))
    return F.concat(F.lit("["), speaker, F.lit("]: "), said)


def clipped(text: Column, chars: int) -> Column:
    """First ``chars`` characters, as shown in a report."""
    return F.substring(text, 1, chars)
