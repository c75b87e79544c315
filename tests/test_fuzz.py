"""Text rules against plain Python on random input."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from layover.functions import text as tx

PIECES = ["EK372", "EK380", "ek380", ",", " ", "\t", "\n", ":", "- ", "* ", "• ", "Tier", "Name", "é", "→", "{", "}", '"', "[", "]",
          '{"chosen_flight": "EK380"}', '{"chosen_flight": "EK372", "seat": "1A"}', '{"chosen_flight": ""}', '{"seat": "2B"}',
          '{"archetype": "X"}', '{"held_flights": ["A", "B"]}', '{"held_flights": "A"}', "```", "```json", "null", "12", "true"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    # Documents with all fields, so that the valid case is common too.
    for _ in range(300):
        fields = {k: rng.choice(["", "EK372", "EK380", "later \"flight\"", "é→"]) for k in rng.sample(
            ["archetype", "chosen_flight", "handoff", "seat", "reasoning_summary"], rng.randint(1, 5))}
        if rng.random() < 0.5:
            fields["held_flights"] = rng.choice([[], ["EK372"], ["EK372", "EK380"], "EK372"])
        document = json.dumps(fields, ensure_ascii=rng.random() < 0.5)
        made.append(rng.choice([document, f"```json\n{document}\n```", f"so {document} then", document + "x", f"```{document} x}}```", f"```{document}]```"]))
    return made, spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").repartition(4)


def results(df, column):
    rows = df.select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_flight_list(texts):
    made, df = texts
    assert results(df, tx.flight_list(F.col("t"))) == [[p.strip() for p in t.split(",") if p.strip()] for t in made]


def test_profile_fields(texts):
    made, df = texts
    expected = []
    for t in made:
        fields = {}
        for line in t.split("\n"):
            found = re.match(r"\s*[-•*]?\s*([^:]+):\s*(.+)", line)
            if found:
                fields[found[1].strip()] = found[2].strip()
        expected.append(fields)
    assert results(df, tx.profile_fields(F.col("t"))) == expected


def test_offered_flight(texts):
    made, df = texts
    expected = ["EK380" if "EK380" in t.upper() and "EK372" not in t.upper() else "EK372" for t in made]
    assert results(df, tx.offered_flight(F.col("t"))) == expected


def test_audit_summary(texts):
    made, df = texts

    def summary(t):
        try:
            document = json.loads(t)
        except ValueError:
            return t
        if not isinstance(document, dict):
            return t
        held = document.get("held_flights")
        if held and not isinstance(held, list):
            return t
        parts = [("Segment", document.get("archetype")), ("Held", None if held is None or held == "" else ", ".join(held)),
                 ("Chosen", document.get("chosen_flight")), ("Handoff", document.get("handoff"))]
        shown = [f"{k}: {v}" for k, v in parts if v or (k == "Held" and v is not None)]
        return " · ".join(shown) or t

    assert results(df, tx.audit_summary(F.col("t"))) == [summary(t) for t in made]
    assert results(df, tx.document_summary(tx.document(F.col("t")), F.col("t"))) == [summary(t) for t in made]


def test_decision_from_text(texts):
    made, df = texts

    def decided(t):
        found = re.findall(r"```(?:json)?\s*(\{.*?\})\s*```", t, re.S | re.I) + re.findall(r"\{[^{}]*\"chosen_flight\"[^{}]*\}", t)
        for candidate in found:
            try:
                document = json.loads(candidate)
            except ValueError:
                continue
            if document.get("chosen_flight"):
                return document["chosen_flight"], document.get("reasoning_summary")
        later = "EK380" in t.upper() and "EK372" not in t.upper()
        return "EK380" if later else "EK372", t[:600]

    got = results(df, tx.decision_from_text(F.col("t")))
    assert [(r["chosen_flight"], r["reasoning_summary"]) for r in got] == [decided(t) for t in made]
