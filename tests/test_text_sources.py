import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.operators import matching as M
from loomwork.operators import resolution as R
from loomwork.operators import text as X
from loomwork.sources import payloads as P


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "dialect", "want"), [("1.234.567", "vn", 1234567.0), ("1.234,5", "vn", 1234.5), ("(1.500)", "vn", -1500.0), ("12,5", "vn", 12.5), ("1,250", "vn", 1250.0), ("n/a", "vn", None), ("-12.524.946", "dots", -12524946.0), ("NA", "plain", None), ("", "plain", None), (None, "vn", None), ("97.47", "plain", 97.47)])
def test_numbers(spark, text, dialect, want):
    assert one(spark, text, lambda c: X.number(c, dialect)) == want


@pytest.mark.parametrize(("text", "want"), [("2024", dt.date(2024, 1, 1)), ("2024-05", dt.date(2024, 5, 1)), ("2024-05-17", dt.date(2024, 5, 1)), ("2024-Q3", dt.date(2024, 7, 1)), ("bad-period", None), ("2024-13", None), (None, None)])
def test_periods(spark, text, want):
    assert one(spark, text, X.period) == want


def test_normalized(spark):
    assert one(spark, "Công-ty  Rạng Đông@VN", X.normalized) == "cong ty rang dong vn"


def test_commerce(spark):
    flags = lambda html: tuple(spark.createDataFrame([(html,)], "t string").select(*X.commerce_flags(F.col("t"))).first())
    assert flags("<p>Our showroom</p>") == (False, False)
    assert flags("<p>shop</p>") == (True, False)
    assert flags('<a class="b" href="/gio-hang">x</a>') == (True, True)
    assert flags('<form action="/add_to_cart">') == (True, True)
    assert flags(None) == (False, False)


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Đơn vị: triệu đồng\nDoanh thu thuần 1.200\nTổng tài sản 5.000\nSố nhân viên 45"), (2, "Total assets 100\nTotal assets 200"), (3, None)], "id int, t string")
    rows = {(r.id, r.field): (r.value, r.warning) for r in X.extract_fields(docs, "id", "t").collect()}
    assert rows[1, "operating_revenue"] == (1_200_000_000.0, None)
    assert rows[1, "employees"] == (45.0, None)
    assert rows[2, "total_assets"] == (None, "ambiguous")
    assert rows[3, "total_equity"] == (None, "missing")


def test_harvest(spark):
    edits = [("revenue", str(v), str(v * 1000)) for v in (1.0, 2.0, 3.0)] + [("employees", "1", "2")] * 2
    rows = [tuple(r) for r in X.harvest(spark.createDataFrame(edits, "field string, before string, after string")).collect()]
    assert rows == [("revenue", 3, "review_aliases", "nghin")]


def test_indel_is_the_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return 2 * row[-1] / (len(a) + len(b))

    for a, b in (("abc", "abd"), ("rangdong", "dongrang"), ("a", "b"), ("masan", "masanconsumer"), ("xyxyx", "yxyxyxy")):
        assert M.indel(a, b) == pytest.approx(slow(a, b))


def test_resolution(spark):
    firms = spark.createDataFrame([(1, "Công ty CP Bóng đèn Phích nước Rạng Đông"), (2, "Công ty CP Sữa Việt Nam"), (3, "Tập đoàn Masan")], "id int, name string")
    shops = spark.createDataFrame([(10, "rangdong.official"), (11, "vinamilk_store"), (12, "masan consumer"), (13, "zzz qqq"), (14, None)], "sid int, shop string")
    got = {r.sid: r.id for r in R.resolve(shops, firms, "sid", "shop", "id", "name").collect()}
    assert got == {10: 1, 11: 2, 12: 3, 13: None, 14: None}


def test_sdmx_xml(spark, tmp_path):
    obs = "".join(f'<Obs TIME_PERIOD="{t}" OBS_VALUE="{v}"/>' for t, v in (("2017-01", "97.47"), ("2017-02", ""), ("2017-03", "NA"), ("bad", "1"), ("2017-05", "116.5")))
    (tmp_path / "a.xml").write_text(f'<m><DataSet><Series INDICATOR="AIP_ISIC4_C_IX" FREQ="M" BASE_PER="2015">{obs}</Series><Series INDICATOR="OTHER" FREQ="M"><Obs TIME_PERIOD="2017-01" OBS_VALUE="1"/></Series></DataSet></m>')
    rows = P.sdmx_xml(spark, str(tmp_path / "a.xml"))
    assert sorted(r.skipped for r in rows.collect() if r.skipped) == ["invalid_OBS_VALUE", "invalid_TIME_PERIOD", "missing_OBS_VALUE"]
    assert [(r.indicator_code, r.value) for r in P.office_series(rows).orderBy("period").collect()] == [("IIP_C", 97.47), ("IIP_C", 116.5)]


def test_sdmx_json(spark):
    body = '{"data":{"dataSets":[{"structure":0,"observations":{"0:0":[96.5,0],"0:1":[null],"1:0":[5.0]}}],"structures":[{"dimensions":{"observation":[{"id":"REF_AREA","values":[{"id":"USA"},{"id":"VNM"}]},{"id":"TIME_PERIOD","values":[{"id":"2023-Q1"},{"id":"2023-Q2"}]}]}}]}}'
    rows = P.sdmx_json(spark.createDataFrame([(1, body)], "id int, b string"), "id", "b", country="USA").collect()
    assert [(r.country, r.period, r.value) for r in rows] == [("USA", dt.date(2023, 1, 1), 96.5)]


def test_pxweb(spark):
    body = '{"meta":{"variables":[{"code":"Industrial activity","values":["0"],"valueTexts":["W"]},{"code":"Year","values":["10","12"],"valueTexts":["2022","Prel. 2024"]}]},"data":{"data":[{"key":["0","10"],"values":["106.82"]},{"key":["0","12"],"values":["111.38"]},{"key":["1","10"],"values":["99"]}]}}'
    rows = P.pxweb(spark.createDataFrame([(1, body)], "id int, b string"), "id", "b").collect()
    assert len(rows) == 24
    assert {(r.period.year, r.value) for r in rows} == {(2022, 106.82), (2024, 111.38)}


def test_commented_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# source: x\n# y\nvsic_code,indicator_code,indicator_name,period,value,unit,source\nC,IIP_C,n,2017-01-01,97.5,i,G\nC,IIP_C,n,bad,97.5,i,G\n")
    assert [(r.period, r.value) for r in P.commented_csv(spark, str(tmp_path / "a.csv")).collect()] == [(dt.date(2017, 1, 1), 97.5)]


def test_listings(spark):
    shopee = '{"data":{"items":[{"item_basic":{"itemid":7,"name":" Lamp ","price":4500000000,"historical_sold":12,"item_rating":{"rating_star":4.5}}},{"item_basic":{"price":1}}]}}'
    r = P.shopee_listings(spark.createDataFrame([(1, shopee)], "id int, b string"), "id", "b").collect()
    assert [(x.product_name, x.price, x.units_sold_est, x.revenue_est, x.rating) for x in r] == [("Lamp", 45000.0, 12, 540000.0, 4.5)]
    tiktok = '{"products":[{"product_id":"9","title":"Milk","price":{"sale_price":"30000"},"sold_count":5},{"title":"Tea","price":10}]}'
    r = P.tiktok_listings(spark.createDataFrame([(1, tiktok)], "id int, b string"), "id", "b").collect()
    assert [(x.product_name, x.price, x.revenue_est) for x in r] == [("Milk", 30000.0, 150000.0), ("Tea", 10.0, None)]


def test_statements(spark):
    j = '{"stock_code":"ral","period":"2024-12-31","fields":{"revenue":5.0},"total_assets":7}'
    r = P.statements_json(spark.createDataFrame([(1, j)], "id int, b string"), "id", "b").first()
    assert (r.stock_code, r.revenue, r.total_assets, r.net_profit) == ("RAL", 5.0, 7.0, None)
    h = '<table id="bctc" data-period="2024-12-31" data-report-type="annual"><tr><td data-field="revenue">1.200.000</td><td data-field="net_profit">(5.000)</td></tr></table>'
    r = P.statements_html(spark.createDataFrame([(1, h)], "id int, b string"), "id", "b").first()
    assert (r.period, r.revenue, r.net_profit) == (dt.date(2024, 12, 31), 1_200_000.0, -5000.0)
    t = "<table><tr><th>x</th><th>Quý 1- 2025</th><th>Quý 2- 2025</th></tr><tr><td>Doanh thu bán hàng</td><td>1.000</td><td></td></tr><tr><td>Giá vốn hàng bán</td><td>600</td><td>5</td></tr></table>"
    r = P.statement_tables(spark.createDataFrame([(1, t)], "id int, b string"), "id", "b").first()
    assert (r.period, r.revenue, r.cost_of_goods, r.gross_margin) == (dt.date(2025, 3, 31), 1_000_000.0, 600_000.0, 0.4)


def test_malformed_log_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\nnot json\n\n{"id":"2"}\n')
    good, bad = P.jsonl(spark, str(tmp_path / "a.jsonl"), "id STRING")
    assert sorted(r.id for r in good.collect()) == ["1", "2"]
    assert bad.first().skipped == 1


def test_resolve_equals_all_pairs(spark):
    import random

    rng = random.Random(8)
    base = ["Công ty cổ phần Sữa Việt Nam", "Rạng Đông", "Tập đoàn Hòa Phát", "FPT", "Masan Group", "Điện Quang", "abcd", "Vĩnh Hoàn", "An Phát Xanh", "Đức Giang", "Thép Nam Kim", "Gỗ An Cường", "Minh Phú", "x"]
    firms = [(i, b) for i, b in enumerate(base)] + [(100 + i, "".join(rng.choices("abcdeghmnot ", k=rng.randint(2, 18)))) for i in range(40)]
    handles = ["abxcd", "abdcd", "vinamilc", "rangdong.official", "hoaphatt", "fpt_shop", "masn", "", "??", "dienqang store"]
    for _, n in firms[:54]:
        n = list(n.lower())
        for _ in range(rng.randint(0, 3)):
            n[rng.randrange(len(n))] = rng.choice("abcdeghmnot")
        handles.append("".join(n).replace(" ", rng.choice(["", ".", "_"])))
    shops = spark.createDataFrame(list(enumerate(handles)), "sid long, shop string")
    f = spark.createDataFrame(firms, "id long, name string")
    s = M.signals(shops, "shop", M.SHOP_NOISE, "shop")
    both = M.signals(f, "name", M.FIRM_NOISE, "firm").withColumn("firm_brands", M.brands(F.col("name"))).crossJoin(s)
    best = {}
    for r in M.scored(both).where(F.col("score") >= M.THRESHOLD).collect():
        best[r.sid] = min(best.get(r.sid, (0.0, 0)), (-r.score, r.id))
    got = {r.sid: (r.score, r.id) for r in R.resolve(shops, f, "sid", "shop", "id", "name").collect()}
    assert set(got) == set(range(len(handles)))
    assert {k: (-v[0], v[1]) for k, v in best.items()} == {k: v for k, v in got.items() if v[1] is not None}
    assert got[0][1] == 6  # abxcd and abcd share no three letters in a row
    assert got[2][1] == 0  # vinamilc, by the brand's own ratio
    assert R.resolve(shops, f.where("false"), "sid", "shop", "id", "name").where("id IS NOT NULL").count() == 0


def test_wrapped_payloads_and_json_within(spark):
    body = '{"data":{"dataSets":[{"structure":0,"observations":{"0":[96.5]}}],"structures":[{"dimensions":{"observation":[{"id":"TIME_PERIOD","values":[{"id":"2023-Q1"}]}]}}]}}'
    rows = P.sdmx_json(spark.createDataFrame([(1, body), (2, f'{{"fetched": "x", "sdmx": {body}}}')], "id int, b string"), "id", "b").orderBy("id").collect()
    assert [(r.id, r.period, r.value) for r in rows] == [(i, dt.date(2023, 1, 1), 96.5) for i in (1, 2)]
    texts = [' {"a": 1} ', '<html>x = {"a": {"b": 2}};</html>', "[1, 2]", "{broken", "} {", "", None, '<p>{"a": 1} and {"b": 2}</p>']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.j for r in df.select("i", P.json_within(df.t).alias("j")).orderBy("i").collect()]
    assert got == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None, None, None]


def test_names_of_helpers_do_not_clash(spark):
    """Frames whose columns have the names of operators' helpers come out with all of them."""
    from loomwork.operators import cleaning as C
    from loomwork.operators import tables as T
    from loomwork.operators import windows as W

    names = ("row_at", "value_before", "value_after", "gap", "line", "run", "held_now", "held_before", "place", "side", "found", "has", "last", "last_year", "month", "wanted", "tier", "best_tier", "was", "valid")
    df = spark.createDataFrame([("a", dt.date(2024, m, 1), float(m) if m != 2 else None, *(f"{n}{m}" for n in names)) for m in (1, 2, 3)], "k string, period date, value double, " + ", ".join(f"{n} string" for n in names))
    mine = lambda out: sorted(tuple(r[n] for n in names) for r in out.collect())
    want = mine(df)
    for out in (
        W.gaps_filled(W.growth(df, ["k"], "value", "g"), ["k"], "value"), W.asof_backward(df, df.selectExpr("k", "period", "value AS other"), ["k"], ["other"]), W.month_on_month(df, ["k"], "value"), W.step_held(df, 1),
        W.preferred_frequency(df.withColumn("freq", df.k), ["k"], preferred="a"), T.cascade([("x", df)], ["k"]), C.validate_codes(df.withColumn("code", df.k), spark.createDataFrame([("a",)], "c string"), "code"),
    ):
        assert mine(out) == want
    assert W.lag_violations(W.lags(df, ["k"], "value", (1,)), ["k"], "value", "value_lag1", 1).isEmpty()


def test_amounts_of_lines_are_computed_once(spark):
    """The rightmost amounts, as number() reads what AMOUNT finds, with each pattern once in the plan."""
    lines = ["a 1.250.000", "b (1.250,5) 7", "c -12,345", "(45)", "1,250.5 x 99", "1.5", "12.345.678,9 (3)", "v1.000", "1.000", "0,5", "1.2.3", "(-250)", "none", "", None, "7 (1,234,567) 8", "1,23", "250,", "5 -(6)", "x 100 99"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    found = df.select("i", F.posexplode(F.regexp_extract_all("t", F.lit(X.AMOUNT), F.lit(1))).alias("place", "token")).select("i", "place", X.number(F.col("token")).alias("v")).where("v IS NOT NULL").collect()
    by = {i: [r.v for r in sorted(found, key=lambda r: r.place) if r.i == i] for i in range(len(lines))}
    want = {i: ([v for v in vs if abs(v) >= 100] or vs or [None])[-1] for i, vs in by.items()}
    got = df.select("i", X.amount(F.col("t")).alias("v"))
    assert {r.i: r.v for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_units_without_their_words_nearby(spark):
    texts = {"Đơn vị: triệu đồng": 1_000_000, "TRIEU VND": 1_000_000, "in  millions of VND": 1_000_000, "Nghìn VNĐ": 1000, "1.000  vnd": 1000, "ngan dong": 1000, "In Thousands": 1000, "million": 1, "tri 1.000": 1, "": 1, None: 1}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unit_scale(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == texts
