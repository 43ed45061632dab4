import pytest
from pyspark.sql import functions as F

from skein.functions import similarity as sim
from skein.functions.folding import cleaned, fold, fold_aggressive, parse_mode, tag
from skein.functions.links import domain, is_catalogue

AGGRESSIVE = {
    "LightSpy - S1185": "lightspy", "win.icefog": "icefog", "win/icefog": "icefog", "win-fakeking": "fakeking", "The Gorgon Group": "gorgon", "Window": "window", "Adapt": "adapt",
    "PowerShell - T1059.001": "powershell", "Process Creation - DS0009": "processcreation", "Network Traffic - DC0001": "networktraffic", "Win Locker": "winlocker", "JS Sniffer": "jssniffer",
    "Earth Preta (Vendor)": "earthpreta", "APT-28": "apt28", "Winnti": "winnti", "Teamviewer": "teamviewer", "(Vendor)": "vendor", "- S1185": "s1185", "The": "the", "Group": "group", "win": "win", "APT": "apt", "((x)": "x",
}


def values(spark, names, column):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, s string").orderBy("i").select(column(F.col("s")).alias("x")).collect()
    return [r["x"] for r in rows]


def test_folding(spark):
    assert values(spark, ["APT28", "apt 28", "a.p.t-28", "Ünïcode_Ωmega 5", "--", ""], fold) == ["apt28"] * 3 + ["ünïcodeωmega5", "", ""]


def test_aggressive_folding(spark):
    assert values(spark, list(AGGRESSIVE), fold_aggressive) == list(AGGRESSIVE.values())


def test_tags_escape_quotes_and_are_empty_without_a_name(spark):
    rows = spark.createDataFrame([("tool", 'A "b"'), ("", "x"), ("tool", ""), (None, "x")], "g string, v string").select(tag("ns", F.col("g"), F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == ['ns:tool="A \\"b\\""', "", "", ""]


def test_modes_and_filter_lists():
    assert [parse_mode(x) for x in (None, " ", "Standard", "AGGRESSIVE ")] == ["standard"] * 2 + ["standard", "aggressive"]
    with pytest.raises(ValueError):
        parse_mode("loose")
    assert cleaned([" B", "a", ""]) == ["a", "b"] and cleaned([" "]) == [] and cleaned(None) == []


@pytest.mark.parametrize(("a", "b", "want"), [("kimsuki", "kimsuky", 0.9429), ("callisto", "calisto", 0.9708), ("toneshel", "toneshell", 0.9778), ("apt28", "apt29", 0.92), ("kimsuki", "callisto", 0.5119), ("", "", 1), ("a", "", 0)])
def test_jaro_winkler(a, b, want):
    assert sim.jaro_winkler(a, b) == pytest.approx(want, abs=5e-5)


def test_odd_transpositions_count_by_half():
    assert sim.jaro("abcdef", "bcadef") == pytest.approx((1 + 1 + (6 - 1.5) / 6) / 3)


def test_tokens_abbreviations_digits(spark):
    rows = spark.createDataFrame([("J. Smith", "John Smith"), ("APT28", "apt 29"), ("x y", "x y"), ("a b", "a"), ("no", "none")], "a string, b string")
    ta, tb = sim.tokens(F.col("a")), sim.tokens(F.col("b"))
    got = rows.select(sim.abbreviation(ta, tb), sim.token_overlap(ta, tb), sim.digit_match(fold(F.col("a")), fold(F.col("b")))).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(1, 0.3333, 1), (0, 0.3333, 0), (0, 1, 1), (0, 0.5, 1), (0, 0, 1)]


def test_domains(spark):
    urls = ["https://www.Example.com/x", "http://user:pw@host.org:8080/y?z#q", "not a url", "", "https://attack.mitre.org/groups"]
    assert values(spark, urls, domain) == ["example.com", "host.org:8080", "", "", "attack.mitre.org"]
    assert values(spark, ["attack.mitre.org", "x"], is_catalogue) == [True, False]
