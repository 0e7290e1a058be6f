import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plainly(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), i, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def base(text):
    return [s for s in pii.spans_of(text) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789+-. ()@aZ%_é\n", max_size=60))
def test_base_kinds_equal_their_patterns(text):
    assert base(text) == plainly(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "1.2.3.4", "+1 (988) 555-2485", "a.b@c.d", "@", "..", "+", " ", "-", "00", "255.", "x@y", "4387 5130-3523 7269", "é"]), max_size=12))
def test_base_kinds_in_joined_pieces(parts):
    text = "".join(parts)
    assert base(text) == plainly(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000 + "x", "+1" + "(" * 200_000, "a" * 200_000 + "@", "@" * 200_000):
        pii.spans_of(text)


def test_added_kinds_and_redaction():
    text = "IBAN DE89370400440532013000, account no: 12345678, http://bob:pw@host.example/ and a@b.co"
    kinds = [k for k, _, _ in pii.spans_of(text)]
    assert {"iban", "account", "login", "email"} <= set(kinds)
    assert "[IBAN]" in pii.redacted(text, pii.spans_of(text)) and "12345678" not in pii.redacted(text, pii.spans_of(text))
    assert pii.spans_of("") == [] and pii.redacted("clean text", []) == "clean text"


def test_rows_with_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (1, "a@b.co", "y"), (None, "", None)]
    got = {tuple(r) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, n_email string")).select("doc_id", "n_email", "spans").collect()}
    assert got == {(1, 0, ""), (1, 1, "email:0:6"), (None, 0, "")}
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    again = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert [r["text"] for r in again] == [None, "[EMAIL]", ""]


def test_redaction_keeps_columns_with_dots_in_their_names(spark):
    from codeloom.llm import pii

    docs = spark.createDataFrame([(1, "to a@b.cd now", "x"), (1, "to a@b.cd now", "x"), (2, None, None)], "doc_id long, text string, `a.b` string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["a.b"]) for r in got.where("text is not null").collect()) == [(1, "to [EMAIL] now", "x")] * 2
    assert pii.redact(docs.limit(0)).count() == 0
