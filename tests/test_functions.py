"""Fixture rows of the scalar functions."""

import json
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from provender.functions import display, evidence, ingredients, keys, nutrition, pages, text, urls


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["y"] for r in df.repartition(3).select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_trim(spark):
    assert values(spark, ["　a　", "\x1ca\x1f", "﻿a", " a b\n"], text.trimmed) == ["a", "a", "﻿a", "a b"]
    assert values(spark, ["　a　", "\x1ca", "﻿a", "\x85a"], text.script_trimmed) == ["a", "\x1ca", "a", "\x85a"]


def test_display_value(spark):
    assert values(spark, ["x", " ", "NaN", " undefined ", "NULL", None, "nul"], text.has_display_value) == [True, False, False, False, False, False, True]


@pytest.mark.parametrize(
    "given, expected",
    [("12.5公克", (12.5, "g")), (" 30 ML ", (30.0, "ml")), ("　5 g　", (5.0, "g")), ("012 g", (None, None)), ("-1 g", (None, None)), ("1,000 g", (None, None)), ("12", (None, None)), (".5 g", (None, None)), ("約5 g", (None, None)), ("5 毫克", (None, None)), ("１２ g", (None, None)), ("12\n", (None, None))],
)
def test_quantity(spark, given, expected):
    q = values(spark, [given], nutrition.quantity)[0]
    assert (q["value"], q["unit"], q["raw"]) == (*expected, given)


@pytest.mark.parametrize("given, unit, expected", [("0大卡", "kcal", 0.0), ("120 毫克", "mg", 120.0), ("120 毫克", "g", None), ("3 G", "g", 3.0), (None, "g", None)])
def test_nutrient(spark, given, unit, expected):
    q = values(spark, [given], lambda c: nutrition.nutrient(c, unit))[0]
    assert (q["value"], q["unit"], q["raw"]) == (expected, unit if expected is not None else None, given or "")


def test_zero_package(spark):
    assert values(spark, ["0公克/包", "0.00 ml", "0.5公克", "10公克", "0公克x2"], nutrition.zero_package) == [True, True, False, False, False]


@pytest.mark.parametrize(
    "given, names, error",
    [
        ("水、糖、鹽", ["水", "糖", "鹽"], None), ("麵粉(小麥、鹽)、糖", ["麵粉(小麥、鹽)", "糖"], None), ("水、、糖", ["水", "糖"], None), ("水、 、糖", ["水", "糖"], None), ("水、", ["水"], None),
        ("、水", [], "empty_ingredient_between_separators"), ("水,,糖", [], "empty_ingredient_between_separators"), ("水、,糖", [], "empty_ingredient_between_separators"), ("水,", [], "trailing_ingredient_separator"), ("水\n", [], "trailing_ingredient_separator"),
        ("水(糖", [], "unbalanced_ingredient_brackets"), ("水)糖", [], "unbalanced_ingredient_brackets"), ("水(糖]", [], "unbalanced_ingredient_brackets"), ("水（糖)", [], "unbalanced_ingredient_brackets"), (" ", [], "empty_content_label"), (None, [], "empty_content_label"),
    ],
)
def test_strict(spark, given, names, error):
    got = values(spark, [given], ingredients.split_strict)[0]
    assert (list(got["names"]), got["error"]) == (names, error)


@pytest.mark.parametrize("given, names", [("、水,,糖、", ["水", "糖"]), ("水（糖)、鹽", ["水（糖)", "鹽"]), ("水(糖、鹽", ["水(糖、鹽"]), ("水;糖", ["水;糖"]), (None, [])])
def test_lenient(spark, given, names):
    assert list(values(spark, [given], ingredients.split_lenient)[0]) == names


def test_first_error_counts(spark):
    """Of several errors the first in order of the text; separators after a bracket that never closes stand inside of it."""
    got = values(spark, ["a,,(", "a(,,", "a),,", "(a]、,", "、(", "a、(b、c)、、d", "[a,(b;c)],d", "a(b\n"], ingredients.split_strict)
    between, brackets = "empty_ingredient_between_separators", "unbalanced_ingredient_brackets"
    assert [g["error"] for g in got] == [between, brackets, brackets, brackets, between, None, None, brackets]
    assert list(got[5]["names"]) == ["a", "(b、c)", "d"] and list(got[6]["names"]) == ["[a,(b;c)]", "d"]


def test_rounding_and_precision(spark):
    xs = [i * 0.05 for i in range(4000)] + [0.35, 0.25, 0.75, 1234.25]
    want = [float(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in xs]
    assert values(spark, xs, nutrition.one_decimal, "double") == want
    assert values(spark, [0.7 * 3, 1e-7, None], nutrition.precision15, "double") == [2.1, 1e-7, None]


def test_reference(spark):
    pct = lambda c: nutrition.daily_pct(c, F.lit("kcal"), F.lit(2000.0), F.lit("kcal"))
    assert values(spark, [1599.9, 1600.0, 2500.0, -1.0, float("nan")], lambda c: nutrition.reference_status(pct(c)), "double") == ["normal", "near", "reached", None, None]
    assert values(spark, [1599.9, 700.0], lambda c: nutrition.pct_label(pct(c)), "double") == ["80%", "35%"]
    assert values(spark, [2500.0], lambda c: nutrition.progress(pct(c)), "double") == [100.0]


def test_freshness(spark):
    got = values(spark, ["2026-05-05", "2026-05-04", "2026-11-02", "2026-02-30", "0000-01-01", "2026-5-5", None], lambda c: nutrition.freshness(c, F.to_date(F.lit("2026-11-01"))))
    assert [g and (g["elapsed_days"], g["is_stale"]) for g in got] == [(180, False), (181, True), None, None, None, None, None]


def test_label_block(spark):
    block = "每一份量 250 毫升\n熱量 100 大卡\n鈉 12.5毫克\n熱量 90 大卡\n蛋白質 3 毫克"
    got = values(spark, [block, "熱量 1.2.3 大卡", ""], nutrition.label_nutrition)
    assert tuple(got[0]["serving"]) == (250.0, "ml") and tuple(got[0]["nutrition"]["calories"]) == (90.0, "kcal") and tuple(got[0]["nutrition"]["protein"]) == (3.0, "mg") and got[0]["error"] is None
    assert got[1]["error"] == "invalid_numeral" and got[2]["serving"] is None and got[2]["error"] is None
    assert [tuple(x) for x in values(spark, [" 30 g ", "一盒", ""], nutrition.serving_text)] == [(30.0, "g", " 30 g "), (None, None, "一盒"), (None, None, None)]


def test_keys(spark):
    assert values(spark, ["統一 ABC-1!", "ß"], keys.name_key) == ["統一abc1", "ss"]
    assert values(spark, ["%E7%B5%B1%E4%B8%80Ａ"], keys.match_key) == ["統一a"]
    assert values(spark, ["  Ｔea—茶 ", "!!"], keys.slugged) == ["tea-茶", "product"]
    assert values(spark, ["https://www.shop.com.tw/x", "https://a.example.org", "https://localhost/"], keys.source_id) == ["shop", "example", "localhost"]
    ids = values(spark, ["A B", "C", "", "茶"], lambda c: keys.candidate_id(c, F.lit("x"), F.lit("y"), F.lit("z")))
    assert ids[:2] == ["tfda-traceability:A-B", "tfda-traceability:C"] and ids[2] == ids[3] and ids[2].startswith("tfda-traceability:missing:") and len(ids[2].split(":")[2]) == 20


@pytest.mark.parametrize("a, b, score", [("茶裏王日式無糖綠茶", "統一茶裏王-日式無糖綠茶 1250ml", 0.6923), ("茶裏王台式綠茶", "統一茶裏王-台式綠茶 600ml", 0.6667), ("A b", "ab!", 1.0), ("", "a", 0.0)])
def test_sequence_ratio(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(keys.sequence_ratio("a", "b")).first()[0] == score
    assert score in (0.0, round(SequenceMatcher(None, *(keys.DROPPED.sub("", x.casefold()) for x in (a, b))).ratio(), 4))


def test_urls(spark):
    got = values(spark, [" HTTP://WWW.Shop.tw?a=1&amp;b#f ", "ftp://x/", "https://m.facebook.com/x", "https://統一.tw/a b", "nothing", None], urls.url_parts)
    assert [g["url"] for g in got] == ["http://www.shop.tw/?a=1&b", None, "https://m.facebook.com/x", "https://統一.tw/a b", None, None]
    reasons = values(spark, ["https://m.facebook.com/x", "https://notfacebook.com", "https://duckduckgo.com/l", "x"], lambda c: urls.exclusion_reason(urls.url_parts(c)))
    assert reasons == ["excluded_domain:m.facebook.com", None, "unresolved_search_redirect", "invalid_url"]
    assert values(spark, ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.tw%2F&x=1", "https://a.tw"], urls.decode_redirect) == ["https://a.tw/", "https://a.tw"]
    assert values(spark, ["brands-統一.html#x"], lambda c: urls.absolute_url(c, F.lit("HTTP://A.tw/b/"))) == ["http://a.tw/b/brands-%E7%B5%B1%E4%B8%80.html"]


def test_display(spark):
    row = spark.createDataFrame([("X", None, "1", None), (None, "M", " ", "T"), (None, None, None, None)], "b string, m string, c string, t string")
    got = [r[0] for r in row.select(display.summary(F.col("b"), F.col("m"), F.col("c"), F.col("t"))).collect()]
    assert got == ["品牌：X · 條碼：1", "製造業者：M · 食品追溯碼：T", ""]
    assert row.select(display.suggestion(F.col("b"), F.col("c"))).first()[0] == "X · 1"
    assert values(spark, [12.0, 12.5, -1.0], lambda c: display.quantity_label(c, F.lit("g")), "double") == ["12 g", "12.5 g", display.MISSING]
    assert values(spark, [12.0, 12.5], lambda c: display.ratio_label(c, F.lit(" % ")), "double") == ["12%", "12.5%"]


def test_evidence(spark):
    assert values(spark, ["12345678", " ", "123", None, "1234567８"], evidence.number_status) == ["valid", "missing", "invalid", "missing", "valid"]
    got = values(spark, [{"官網": "見 https://a.tw/x, http://b.tw）", "電話": "https://c.tw"}], evidence.field_urls, "map<string,string>")[0]
    assert [tuple(g) for g in got] == [("官網", "https://a.tw/x"), ("官網", "http://b.tw")]


def test_pages():
    html = '<div class="item cate-1"><a href="brands-x.html"><img alt=" X  y "></a></div><a data-rel="cate-1">Tea</a><a data-rel="12" data-name="A  b">q</a><a data-rel="z" data-name="n">q</a>'
    assert pages.brand_cards(html) == [("X y", "brands-x.html", "Tea")]
    assert pages.product_anchors(html) == [("12", "A b")]
    assert pages.sitemap_links('<a href="/brands-12.html">n</a><a href="/brands-a.html">n <b>m</b></a>') == [("n m", "/brands-a.html", "")]
    page = '<div class="product-introduction"><h2>B</h2><div class="bd">said <p>more</p><script>x</script><div class="box">no</div></div><div class="product-box"><i data-name="P 1"></i><img src="/p.png"></div><div class="product-box"><div class="description">p 1</div></div><div class="qlink"><a href="/l">L</a></div></div>'
    assert pages.brand_page(page) == ("B", "said more", [("P 1", "/p.png")], [("L", "/l")])
    assert pages.brand_page("<p>x") is None
    assert pages.product_heading('<h1>Tea <span class="gray">30 g</span> x</h1>') == ("Tea x", "30 g")
    assert pages.json_ld_products('<script type="application/ld+json">{"@type":"Product","name":" n ","url":"u"}</script>') == [("n", "u")]
    nodes = [{"goodsBarcode": 1, "goodsShowName": 2, "goodsSpec": 3, "details": 4}, "471", "N", None, "<table>"]
    assert pages.embedded_record(f'<script id="__NUXT_DATA__">{json.dumps(nodes)}</script>') == ("471", "N", None, "<table>")
    assert pages.table_rows("<table><tr><td>a  b</td><td>c<br>d</td></tr><tr><td>x</td></tr></table>") == [("a b", "c\nd")]


def _strict(text):
    """(names, error) by the plainest reading of the rules, sign by sign."""
    space = lambda s: s.strip() == ""
    if space(text):
        return [], ingredients.EMPTY
    pairs = dict(ingredients.BRACKETS)
    parts, seps, open_, whole, now = [], [], [], True, ""
    for c in text:
        if c in pairs:
            open_.append(pairs[c])
        elif c in pairs.values():
            if not open_ or open_.pop() != c:
                whole = False
                break
        elif c in ingredients.SEPARATORS and not open_:
            parts.append(now)
            seps.append(c)
            now = ""
            continue
        now += c
    if not whole:
        pass
    elif open_:
        whole = False
    i = 1
    while i < len(seps):  # an ideographic comma after another, nothing between
        if seps[i - 1] == seps[i] == "、" and space(parts[i]):
            del parts[i], seps[i]
        else:
            i += 1
    if any(space(p) for p in parts):
        return [], ingredients.BETWEEN
    if not whole:
        return [], ingredients.UNBALANCED
    names = [*parts, now]
    if space(now):
        if seps and seps[-1] != "、":
            return [], ingredients.TRAILING
        names = parts
    return [n.strip() for n in names], None


def _lenient(text):
    depth, parts, now = 0, [], ""
    for c in text:
        if c in ingredients.LENIENT_SEPARATORS and not depth:
            parts.append(now)
            now = ""
            continue
        depth = depth + 1 if c in ingredients.LENIENT_BRACKETS[0] else max(0, depth - 1) if c in ingredients.LENIENT_BRACKETS[1] else depth
        now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def test_splitting_against_brute_force(spark):
    """Random texts of brackets, separators, white space and code points for private use."""
    import random

    rng = random.Random(11)
    signs = list("、、、,，;；\n\r()（）[]【】{}") + ["a", "鹽", " ", "　", "\x1c", "", "", "", "", "\U000f0000", "é", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)] + ["".join(rng.choices("、,a 鹽\n", k=rng.randint(0, 9))) for _ in range(1500)]
    got = values(spark, texts, ingredients.split_strict)
    for t, x in zip(texts, got):
        assert (list(x["names"]), x["error"]) == _strict(t), repr(t)
    for t, x in zip(texts, values(spark, texts, ingredients.split_lenient)):
        assert list(x) == _lenient(t), repr(t)
