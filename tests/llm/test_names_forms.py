import unicodedata

from almagest.llm import confusables, namematch

NAMES = "name_key string, raw_name string, source_id bigint, status string, checked_at string, label string"
SOURCES = "id bigint, main_id string, kind string"
ALIASES = "prefix string, alias string, label string"

ENTRIES = [(1, "KRV 9783241"), (2, "HLX J101114.1+261133"), (3, "NAME Surteb Loddektig Deep Field"), (4, "QTS 9783241"), (5, "NAME Gagvik Solvutluk Bridge"), (6, "OBRX 12"), (7, None)]
CASES = {
    "the krv-09,783,241 (?)": 1,
    "K​RV ９７８３２４１": 1,
    "Korvane Radoi Venture No. 9783241": 1,
    "Quentis cataloguue #9783241 - see notes": 4,
    "hlx J10h11m14.1s+26d11m33s": 2,
    "Halixon Survey 10 11 14.1 +26 11 33": 2,
    "HLX J101114.1-261133": None,
    "Surteb Loddekktig champ": 3,
    "field of Solvutluk, Ggavik (Bridge)": 5,
    "Surteb Vonmizfel Deep Field": None,
    "KRV 978324": None,
    "LORN 9783241": None,
    "OBRX 012": 6,
    "calibrator, slot 12": None,
    "": None,
    "???": None,
    "x" * 20000: None,
}


def frames(spark, cases=CASES, entries=ENTRIES):
    n = [(f"k{i}", c, None, "pending", None, "l") for i, c in enumerate(cases)]
    n += [("nul", None, None, None, None, None), ("k0", next(iter(cases), None), None, "pending", None, None), ("has", "KRV 9783241", 1, "resolved", None, None)]
    a = [("KRV", "Korvane Radio Venture", "x"), ("QTS", "Quentis catalogue", "x"), ("HLX", "Halixon Survey", "x"), ("OBRX", None, None), (None, "y", None)]
    return spark.createDataFrame(n, NAMES), spark.createDataFrame([(i, m, "z") for i, m in entries], SOURCES), spark.createDataFrame(a, ALIASES)


def test_names(spark):
    f = frames(spark)
    got = {r.name_key: (r.entry_id, r.status) for r in namematch.matches(*f).collect()}
    assert got == {**{f"k{i}": (w, "matched" if w else "unmatched") for i, w in enumerate(CASES.values())}, "nul": (None, "unmatched"), "has": (1, "matched")}
    assert {r.name_key for r in namematch.found(*f).collect()} == {f"k{i}" for i, w in enumerate(CASES.values()) if w}


def test_no_names_or_entries(spark):
    n, s, a = frames(spark)
    assert namematch.found(n.limit(0), s, a).count() == 0
    assert namematch.matches(n, s.limit(0), a.limit(0)).where("status = 'matched'").count() == 0


def test_resolved_names_come_out_right(spark):
    data = "/root/testdata/sf0.01"
    n, s, a = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("names", "sources", "catalog_aliases")]
    m = namematch.matches(n, s, a).join(n.where("source_id is not null").select("name_key", "source_id").distinct(), "name_key")
    assert m.count() > 150 and m.where("entry_id is null or entry_id <> source_id").count() <= 0.01 * m.count()


def test_set_join_is_exact(spark):
    import random

    rnd = random.Random(2)
    sets = [sorted(rnd.sample(range(30), rnd.randrange(1, 9))) for _ in range(120)]
    q = spark.createDataFrame(list(enumerate(sets[:60])), "q int, tokens array<bigint>")
    r = spark.createDataFrame(list(enumerate(sets[60:])), "r int, tokens array<bigint>")
    for t in (0.3, 0.5, 0.8, 1.0):
        j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        want = sorted((i, k) for i, x in enumerate(sets[:60]) for k, y in enumerate(sets[60:]) if j(x, y) >= t)
        assert sorted((x.q, x.r) for x in namematch.set_join(q, r, t).collect()) == want


def test_visual_forms(spark):
    nfd = lambda t: unicodedata.normalize("NFD", t)
    nbsp, zwsp = chr(0xA0), chr(0x200B)
    rows = {
        "a": (nfd("Brücke"), True), "b": ("Brücke", False), "c": (chr(0x41A) + "rv 1", True), "d": ("Крв", False), "e": (f"x{nbsp}y", True),
        "f": ("가 x", False), "g": (nfd("가 x"), True), "h": ("", False), "i": (None, False),
        "j": ("5 μJy − “x”", False), "k": (chr(0xFB01) + "ne\n\tx", True), "l": ("y" * 50000 + zwsp, True),
    }
    t = spark.createDataFrame([], "chunk_id bigint, text string")
    n = spark.createDataFrame([(k, v[0]) for k, v in rows.items()] + [("a", nfd("Brücke"))], "name_key string, raw_name string")
    r = spark.createDataFrame([(1, "ok", "x"), (2, "１", "x")], "id bigint, quote string, text string")
    got = {(x.table_name, x.row_key) for x in confusables.found(t, n, r).collect()}
    want = {("names", k) for k, v in rows.items() if v[1]} | {("requests", "2")}
    assert got == want
    c = {x.row_key: x.canonical for x in confusables.canonical(n.selectExpr("name_key as row_key", "raw_name as text")).collect()}
    assert c["a"] == c["b"] and c["f"] == c["g"] == "가 x" and c["i"] is None and c["d"] == "Крв" and c["k"] == "fine\n\tx"


def test_accents_are_joined_and_ordered_by_their_class(spark):
    """q with dot below and dot above has no single character, so only the
    collation tells that both orders are the same; case and accents count."""
    below, above, acute = chr(0x323), chr(0x307), chr(0x301)
    forms = [f"q{below}{above} x", f"q{above}{below} x", f"q{above} x", f"Q{below}{above} x", f"e{acute}{below}", f"e{below}{acute}", "e", "E"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(forms)] + [(8, None, 1), (9, "", 1)], "i int, text string, canonical_of int")
    c = {r.i: r.canonical for r in confusables.canonical(df).collect()}
    assert c[0] == c[1] and len({c[0], c[2], c[3], c[7]}) == 4 and c[4] == c[5] and c[6] != c[7] and c[8] is None and c[9] == ""
    assert all(unicodedata.normalize("NFC", c[i]) == unicodedata.normalize("NFC", t) for i, t in enumerate(forms))
    assert confusables.canonical(df.limit(0)).count() == 0
