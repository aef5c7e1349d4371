import pytest
from pyspark.sql import functions as F

from recweld.functions import fuzzy
from recweld.functions.addresses import ADDRESS_FIELDS, PlaceTables, with_addresses
from recweld.functions.names import legal_form, repaired, skeleton, with_names
from recweld.functions.translit import transliterate

NAMES = [
    ("Heartland Online L.L.C. (ID: 10156)", "US", "heartland online llc", "heartland online", "llc", "", "hrtlnd onln", False),
    ("Veoaria Sys d/b/a Heartland Online LLC", "US", "heartland online llc", "heartland online", "llc", "veoaria sys", "hrtlnd onln", False),
    ("heartlandonline.com", "US", "heartlandonline", "heartlandonline", "", "", "hrtlndnln", True),
    ("re1iablesilversquare.com", "US", "reliablesilversquare", "reliablesilversquare", "", "", None, True),
    ("RAMRAJ lNDIA PRÍVATE LIMITED", "India", "ramraj india pvt ltd", "ramraj india", "ltd pvt", "", "rmrj ind", False),
    ("Gpa Net Pfrivate (Limited)", "India", "gpa net pvt ltd", "gpa net", "ltd pvt", "", None, False),
    ("Safe Plumbing - 6404788118", "US", "safe plumbing", "safe plumbing", "", "", "sf plmbng", False),
    ("Dr Prakasam Consultech Private Private Limited", "India", "dr prakasam consultech pvt ltd", "prakasam consultech", "ltd pvt", "", None, False),
    ("Jardins Lycee [S.A.S.]", "France", "jardins lycee sas", "jardins lycee", "sas", "", "jrdns lk", False),
    ("B+ Retail Inc", "US", "b plus retail inc", "b plus retail", "inc", "", None, False),
    ("Acme (France) Piatve", "France", "acme piatve", "acme piatve", "", "", None, False),
    ("The Ltd", "US", "the ltd", "the ltd", "ltd", "", None, False),
    ("", "", "", "", "", "", "", False),
    (None, None, "", "", "", "", "", False),
]


def test_names(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(NAMES)], "i int, raw string, land string").selectExpr("*", "1 as name_full")
    got = {r["i"]: r for r in with_names(df, "raw", "land").collect()}
    for i, (_, _, full, core, legal, alias, skel, domain) in enumerate(NAMES):
        r = got[i]
        assert (r["name_full"], r["name_core"], r["name_legal"], r["name_alias"], r["name_is_domain"]) == (full, core, legal, alias, domain)
        assert skel is None or r["name_skel"] == skel
        assert r["name_nospace"] == core.replace(" ", "")
    assert with_names(df.limit(0), "raw", "land").count() == 0


ADDRESSES = [
    ("22 Green Field Pl, Texas, Sping", "22 green field pl sping", "green field pl", "sping", "tx", "22", "22", ""),
    ("22 Green Field Place, Spring, TX", "22 green field pl spring", "green field pl", "spring", "tx", "22", "22", ""),
    ("407/7, CHETAK CENTRE, R.N.T. MARG, Madhya Pradesh", "407 7 chetak centre r n t mrg", "", "chetak centre|r n t mrg", "in_mp", "407 7", "407", ""),
    ("3377-C 207TH AVE E, BROKEN ARROW, OK", "3377 c 207 ave e broken arrow", "c ave e", "broken arrow", "ok", "3377 207", "3377", ""),
    ("145 Peabody Road, N/A, Vacaville, California", "145 peabody rd vacaville", "peabody rd", "vacaville", "ca", "145", "145", ""),
    ("Shop 4, Near SBI ATM, MG Road, Indore, MP", "4 mg rd indore", "", "mg rd|indore", "in_mp", "4", "4", "sbi atm"),
    ("11 Rue Des Debris St Etienne, Lille", "11 r des debris st etienne lille", "r des debris st etienne", "lille", "", "11", "11", ""),
]


def addresses(spark, raws, places=None):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [{k: r[k] for k in ADDRESS_FIELDS} for r in with_addresses(df, "raw", places).orderBy("i").collect()]


def test_addresses(spark):
    for got, (raw, norm, street, locality, region, nums, hnum, landmark) in zip(addresses(spark, [a[0] for a in ADDRESSES]), ADDRESSES, strict=True):
        assert got == {"addr_norm": norm, "addr_street": street, "addr_locality": locality, "addr_region": region, "addr_nums": nums, "addr_hnum": hnum, "addr_landmark": landmark, "addr_blank": False}, raw


def test_blank_addresses(spark):
    assert all(r["addr_blank"] and r["addr_norm"] == "" for r in addresses(spark, [None, "", "NULL", "None", "n.a., -"]))


def test_regions_of_france(spark):
    raws = ["11 Rue Nationale, Lille, Hauts-de-France", "3 Quai, Nantes, Loire-Atlantique", "Cannes, Provence-Alpes-Côte d'Azur", "Dijon, Côte-d'Or", "PARIS", "1 Rue X, Vierzon, Cher"]
    assert [r["addr_region"] for r in addresses(spark, raws)] == ["fr_hdf", "fr_pdl", "fr_pac", "fr_bfc", "fr_idf", "fr_cvl"]


def test_aliases_of_places(spark):
    own = PlaceTables({"fr_pac": ["paca"]}, [("azur", "paca", 400), ("nizza", "nice", 5), ("unit 5", "nice", 9), ("rare", "paca", 9), ("xy", "nice", 9)])
    azur, nizza, rare, unit = addresses(spark, ["Azur", "Nizza", "rare", "xy"], own)
    assert azur["addr_region"] == "fr_pac" and nizza["addr_locality"] == "nice" and rare["addr_locality"] == "rare" and unit["addr_locality"] == "xy"
    assert "unit 5" not in own.localities
    assert addresses(spark, ["Hyderabad, TN"])[0]["addr_region"] == "tn"  # shared codes merge


def test_words(spark):
    words = ["construction", "kanstrakshan", "2024", "re1iable", "0utsourcing", "4th", "2nd", "3m", "b2b"]
    got = {r["w"]: (r["s"], r["r"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", skeleton(F.col("w")).alias("s"), repaired(F.col("w")).alias("r")).collect()}
    assert got["construction"][0] == got["kanstrakshan"][0] == "knstrksn" and got["2024"][0] == "2024"
    assert [got[w][1] for w in words[3:]] == ["reliable", "outsourcing", "4th", "2nd", "3m", "b2b"]


def test_legal_forms(spark):
    cases = {"limited": "ltd", "limitted": "ltd", "pfrivate": "pvt", "piatve": None, "corporatoin": "corp", "compani": "co", "llc": "llc", "lamp": None, "compnay": "co", "incorporatd": "inc", "internet": None}
    got = {r["w"]: r["f"] for r in spark.createDataFrame([(w,) for w in cases], "w string").select("w", legal_form(F.col("w")).alias("f")).collect()}
    assert got == cases


def test_transliteration():
    assert transliterate("Ünïcode Straße №5") == "unicode strasse no5"
    assert transliterate("कमल") == "kamala" and transliterate("हिन्दी").startswith("hind")
    assert transliterate("東京 ☕").split() and transliterate("Москва").startswith("mo") and transliterate(None) == ""
    assert all(transliterate(chr(c)).isascii() for c in range(0, 0x3000, 7))


def one(f, a, b):
    return float(f([a], [b])[0])


def test_similarities():
    ratio, sort, words_, partial, jw = (lambda a, b, f=f: one(f, a, b) for f in (fuzzy.ratios, fuzzy.token_sort_ratios, fuzzy.token_set_ratios, fuzzy.partial_ratios, fuzzy.jaro_winklers))
    assert ratio("piatve", "private") == pytest.approx(1000 / 13) and ratio("", "") == 100 and ratio("a", "") == 0
    assert jw("dwayne", "duane") == pytest.approx(0.84) and jw("", "a") == 0
    assert jw("martha", "marhta") == pytest.approx(0.9611111)
    assert sort("fuzzy wuzzy was a bear", "was a bear fuzzy wuzzy") == 100
    assert words_("mets vs braves", "braves vs mets at home") == 100 and words_("", "a") == 0
    assert partial("bear", "a bearer") == 100 and partial("xbear", "bear") == 100 and partial("", "") == 100 and partial("", "a") == 0
    for a in ("heartland online", "online heartland", "a", "b c"):
        for b in ("heartland online", "on", "c b a"):
            for f in (ratio, sort, words_, partial):
                assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a)) and f(a, a) == 100


def plain_ratio(a, b):
    """By the table of the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def plain_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    wholes = [" ".join(w for w in (both, own) if w) for own in (left, right)]
    if both and not (left and right):
        return 100.0
    return max([plain_ratio(*wholes)] + [plain_ratio(both, w) for w in wholes if both])


def plain_partial(a, b):
    if not a or not b:
        return 100.0 * (a == b)
    every = lambda s, t: max(plain_ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
    return max(every(s, t) for s, t in ((a, b), (b, a)) if len(s) <= len(t))


def test_batches_equal_the_definitions():
    import random

    rng = random.Random(2)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    pairs = [(say("abc d", 14), say("abc d", 14)) for _ in range(300)] + [(say("ab cdé日", 90), say("abcd é日", 90)) for _ in range(30)]
    pairs += [(w := say("abc ", 64).ljust(64, "x"), w[::-1]), ("a" * 64, "a" * 63 + "b"), ("x" * 70, "x" * 69 + "y"), ("".join(map(chr, range(200, 900))), "ab")]
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    sorted_words = lambda t: " ".join(sorted(t.split()))
    for f, plain in ((fuzzy.ratios, plain_ratio), (fuzzy.token_sort_ratios, lambda x, y: plain_ratio(sorted_words(x), sorted_words(y))), (fuzzy.token_set_ratios, plain_set_ratio)):
        assert f(a, b).tolist() == pytest.approx([plain(x, y) for x, y in pairs]), f
    short = [p for p in pairs if max(map(len, p)) <= 60] + pairs[-3:-1]
    assert fuzzy.partial_ratios(*([p[i] for p in short] for i in (0, 1))).tolist() == pytest.approx([plain_partial(*p) for p in short])
    assert fuzzy.jaro_winklers(a, b).tolist() == pytest.approx([fuzzy._jaro_winkler_long(x, y) if x and y else 0.0 for x, y in pairs])


def test_prefixes_and_nulls(spark):
    rows = [("abcd", "abxx"), ("", ""), ("a", ""), (None, "a"), ("x\ny", "x\nz"), ("aXb", "aYb")]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(fuzzy.prefix_similarity("a", "b"), fuzzy.suffix_similarity("a", "b"), fuzzy.similarity_columns({"r": ("ratio", "a", "b")}).alias("f")).collect()
    assert [r[0] for r in got[:3]] == [0.5, 1.0, 0.0] and got[4][0] == pytest.approx(2 / 3) and got[5][1] == pytest.approx(1 / 3)
    assert got[3]["f"]["r"] is None and got[1]["f"]["r"] == 100
