import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.lang import Kind, Matcher, QueryError, parse, parse_duration, parse_matcher, parse_time, selector_text
from tidegrid.regex import BadPattern, to_java

NOW = 10**12


def test_bare_metric():
    q = parse(" tank_level ", NOW)
    assert (q.metric, q.matchers, q.function) == ("tank_level", (), None)
    assert (q.start, q.end) == (NOW - 300_000, NOW)


def test_labels():
    q = parse('tank_level{site="north", unit!="3"}', NOW)
    assert [str(m) for m in q.matchers] == ['site="north"', 'unit!="3"']
    assert str(q) == 'tank_level{site="north", unit!="3"}'
    assert selector_text("m", ()) == "m"


@pytest.mark.parametrize("name", ["sum", "avg", "max", "min", "delta", "count", "rate", "SUM"])
def test_functions(name):
    q = parse(f"{name} ( tank_level )", NOW)
    assert (q.function, q.metric) == (name.lower(), "tank_level")


@pytest.mark.parametrize(("text", "seconds"), [("x[7s]", 7), ("x[90m]", 5400), ("x[3h]", 10_800), ("x[2d]", 172_800), ("max(x[11m])", 660), ("x", 300), ("x[5m] ", 300), ("x[0s]", 0)])
def test_ranges(text, seconds):
    assert parse(text, NOW).range_ms == seconds * 1000


def test_all_parts():
    q = parse('delta(valve_turns{state=~"op.*",site!~"s[0-9]"}[45m])', NOW)
    assert (q.function, q.metric, q.range_ms) == ("delta", "valve_turns", 2_700_000)
    assert [(m.kind, m.name, m.value) for m in q.matchers] == [(Kind.RE, "state", "op.*"), (Kind.NRE, "site", "s[0-9]")]


@pytest.mark.parametrize("text", ["", "  ", "foo(x)", '{a="b"}', 'm{a="b"', "a}b{", "m{x}", 'm{a=~"("}', "median(x)"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text, NOW)


def test_operator_inside_a_value_does_not_count():
    m = parse_matcher('host="a!=b"')
    assert (m.kind, m.name, m.value) == (Kind.EQ, "host", "a!=b")
    assert parse('m{a="x,y", , b!="z",}', NOW).matchers[0].value == "x,y"


def test_nested_call_names_a_metric_unless_strict():
    assert parse("sum(rate(x[5m]))", NOW).metric == "rate(x[5m])"
    with pytest.raises(QueryError):
        parse("sum(rate(x[5m]))", NOW, strict=True)


@pytest.mark.parametrize(("text", "ms"), [("1700000000", 1_700_000_000_000), ("32503680000", 32_503_680_000), ("1970-01-01T00:00:01Z", 1000), ("1970-01-01T01:00:00.5+01:00", 500)])
def test_times(text, ms):
    assert parse_time(text) == ms


@pytest.mark.parametrize("text", ["", "1.5", "yesterday", "1970-13-01T00:00:00Z", "1_000", "\uff11\uff12", "\uff11970-01-01T00:00:01Z"])
def test_bad_times(text):
    with pytest.raises(QueryError):
        parse_time(text)


@pytest.mark.parametrize(("text", "ms"), [("60", 60_000), ("0.5", 500), ("1h30m", 5_400_000), ("500ms", 500), ("-1s", -1000)])
def test_durations(text, ms):
    assert parse_duration(text) == ms


@pytest.mark.parametrize("text", ["", "1_000", "\uff11", "inf", "nan", "1e999", "5x", "m"])
def test_bad_durations(text):
    with pytest.raises(QueryError):
        parse_duration(text)


REFUSED = [r"(a)\1", "(?=a)", "(?!a)", "(?<=a)b", "a++", "(?>a)", "(?U)a", "(", ")", "[a", "*a", r"\Z", "[[:nope:]]", "(?i)*", "(?i)+a", "a|*", "(*)", "a**", "a{1001}", "a{2,1}", "(a{40}){40}", "((a{10}){10}){11}", "(?P<x>a)(?P<x>b)", "(?P<x-y>a)", "(?-)", "(?i-)", "[z-a]", r"\y", r"\8", r"\x{110000}", r"\p{Nope}", r"\pq", "a\\", r"[\b]"]
ALLOWED = ["(?)", "(?:)", "a{,2}", "a{1000}", "(a{30}){30}", "(?i)a", "(?s-m)a", "|", "()", "(|a)*", "a*?", "^*", r"\p{Greek}", r"\pL", r"\P{^Lu}", r"\123", r"\x41", r"\Q*\E+", "[]a]", "[^]a]", "[a-]", "[-a]", r"[\d-z]", "{", "}", "]", "a{2}{", r"[\s\v]", "[[a]", "[a&&b]"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_refused(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def test_allowed_patterns_are_java(spark):
    for p in ALLOWED:
        spark._jvm.java.util.regex.Pattern.compile(to_java(p))


def test_patterns_in_spark(spark):
    cases = [("\x0b", r"\s", False), ("\x0b", r"[\v]", True), ("S", r"\123", True), ("λ", r"\p{Greek}", True), ("a{,2}", "a{,2}", True), ("-", "[a-]", True), ("&", "[a&&b]", True), ("a\n", "a", False), ("a\r", "..", True), ("xyz", "[[:alpha:]]+", True), ("a&b", "[a&&b]+", True), ("ab", "(?P<x_y>a)b", True), ("A", "(?i)a", True), ("a.b", r"\Qa.b\E", True), ("x]", "[]x]+", True), ("{", "{", True), ("ab", "a", False)]
    for text, pattern, hit in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.where(df.t.rlike(to_java(pattern))).count() == int(hit), (text, pattern)


def test_whatever_passes_is_java(spark):
    compile_ = spark._jvm.java.util.regex.Pattern.compile

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text("ab.|()*+?[]{}^$-,2", max_size=7), st.lists(st.sampled_from(["(?i)", "(?", ")", "(", "a", "*", "{2}", "[^", "]", "-", "\\d", "\\p{L}", "[:alpha:]", "&&", "\\Q", "\\E", "|", "?", "#", " "]), max_size=7).map("".join)))
    def check(p):
        try:
            text = to_java(p)
        except BadPattern:
            return
        compile_(text)

    check()


def test_matcher_checks_its_pattern():
    with pytest.raises(ValueError):
        Matcher(Kind.NRE, "a", "(?=x)")
