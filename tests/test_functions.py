"""Scalar functions, entity resolution, sources and sinks on small fixtures."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import codes as C, packs as P, text as T
from shelfmark.operators import matching as M, plan
from shelfmark.session import saver
from shelfmark.sources import readers as R, sinks as S
from shelfmark.streaming import state


def _one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).first())


def test_pack_quantity(spark):
    cases = [("Pkg of 5", "", 5), ("100/Box", "", 100), ("", "Flexform Saliva Ejector 100/Pack", 100), ("", "Bur FG (12)", 12), ("", "Points 334 (1 x 8)", 8), ("", "Gloves Case of 1000", 1000), ("", "Elevator", None)]
    assert _one(spark, *[P.parse_pack_quantity(F.lit(p), F.lit(n)) for p, n, _ in cases]) == [q for *_, q in cases]


def test_sku_strength(spark):
    s = _one(spark, *[T.sku_strength(F.lit(x)) for x in ("0044", "8111", "8234155", "DCG30UNI", "0000", "")])
    assert s[0] < 0.4 and s[1] < 0.4 and s[2] > 0.7 and s[3] > 0.9 and s[4] <= 0.1 and s[5] == 0


def test_text(spark):
    assert _one(spark, T.strip_diacritics(F.lit("Größé Ñandú")), T.sku_model_core(F.lit("219-4302")), T.slugify(F.lit(" Héllo, World! "))) == ["Große Nandu", "4302", "hello-world"]
    assert _one(spark, T.tokenize_name(F.lit("Premier Elevators, .04 glass")))[0] == ["premier", "elevator", "04", "glass"]
    brands = [T.brand_tokens(F.lit(b)) for b in ("Kuraray America", "Kuraray", "Kerr Endodontics", "Premier", "Pkg of 5")]
    assert _one(spark, T.brands_agree(brands[0], brands[1]), T.brands_agree(brands[2], brands[3]), T.brands_agree(brands[4], brands[3])) == ["match", "conflict", "unknown"]


@pytest.mark.parametrize("code, ok", [("036000291452", True), ("0036000291452", True), ("00036000291452", True), ("96385074", True), ("036000291453", False), ("1234567", False), ("012345678901234", False), ("", False)])
def test_gtin(spark, code, ok):
    assert _one(spark, C.valid_gtin(F.lit(code)))[0] is ok
    if ok and len(code) > 8:
        assert "00036000291452" in _one(spark, C.gtin_variants(F.lit(code)))[0]


def test_barcodes(spark):
    gs1 = lambda x: _one(spark, C.parse_gs1(F.lit(x)))[0]
    g = gs1("(01)00605861017657(10)13593092(17)281204")
    assert (g.gtin, g.lot, str(g.expiry)) == ("00605861017657", "13593092", "2028-12-04")
    g = gs1("0100605861017657" + "10" + "13593092" + "\x1d" + "17" + "281204")
    assert (g.gtin, g.lot, str(g.expiry)) == ("00605861017657", "13593092", "2028-12-04")
    g = gs1("]d20100605861017657172812041013593092")
    assert (g.gtin, str(g.expiry)) == ("00605861017657", "2028-12-04")
    g = gs1("(01)00616784430225(10)24140121021Z(11)241212(30)10")
    assert (g.lot, g.expiry) == ("24140121021Z", None)
    h = _one(spark, *[C.parse_hibc(F.lit(x)) for x in ("+D701ER242/$$32802122602122", "+H65811267571L", "*+H6581126757 1L*", "plain")])
    assert (h[0].lic, h[0].pcn, h[0].lot, str(h[0].expiry)) == ("D701", "ER24", "260212", "2028-02-12")
    assert [(x.lic, x.pcn) for x in h[1:3]] == [("H658", "1126757")] * 2 and h[3] is None


def _listings(spark, rows):
    return spark.createDataFrame([(i, s, sku, b, n, p) for i, (s, sku, b, n, p) in enumerate(rows)], "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string")


def _match(spark, rows):
    save = saver(spark)
    f = save(M.features(_listings(spark, rows)))
    scored = save(M.score_pairs(M.candidate_pairs(M.blocking_index(f)), f))
    return f, scored, save(M.clusters(scored, f, save))


def test_matching(spark):
    f, scored, members = _match(spark, [
        ("dc", "1003371", "Premier", "Premier Elevator Cameron", ""), ("pd", "1003371", "Premier", "Premier Elevators Cameron", ""),
        ("dc", "4732", "", "O-Ring for Star 430 / Solara 2/Pack 4732", ""), ("pd", "4732", "Now Foods", "Oregano Oil Enteric 90 Sgels", ""),
        ("a", "BE306S", "Best", "Nitrile Glove Blue 100/Box", "100/Box"), ("b", "BE306S", "Best", "Nitrile Gloves Blue 100/Box", "100/Box"),
    ])
    got = {(r.left_id, r.right_id): r for r in scored.collect()}
    assert got[0, 1].status == "exact" and got[0, 1].confidence >= 75 and got[4, 5].status == "exact"
    assert got[2, 3].status == "reject"
    c = {r.listing_id: r.cluster for r in members.collect()}
    assert c[0] == c[1] and c[4] == c[5] and c[2] != c[3]
    ids = {r.cluster: r.canonical_id for r in M.canonical_ids(members, f).collect()}
    assert all(v.startswith("mcp_auto_") and len(v) >= 21 for v in ids.values())
    f2, _, again = _match(spark, [("b", "BE306S", "Best", "Nitrile Gloves Blue 100/Box", "100/Box"), ("a", "BE306S", "Best", "Nitrile Glove Blue 100/Box", "100/Box")])
    assert {r.canonical_id for r in M.canonical_ids(again, f2).collect()} == {ids[c[4]]}


def test_a_listing_without_pack_does_not_weld_two(spark):
    _, _, members = _match(spark, [
        ("a", "XY1234", "Acme", "Fine Paper Point Taper 100/Box", ""), ("b", "XY1234", "Acme", "Fine Paper Point Taper 100/Box", ""),
        ("c", "XY1234", "Acme", "Fine Paper Point Taper 200/Box", ""), ("d", "XY1234", "Acme", "Fine Paper Point Taper", ""),
    ])
    c = {r.listing_id: r.cluster for r in members.collect()}
    assert c[0] == c[1] != c[2]


def test_readers(spark, tmp_path):
    (tmp_path / "i.csv").write_text('Description,Qty,Unit Price,SKU\n"Gloves ""L"", blue",2,"$1,012.50",AB-1\n\n,,,\nab,1,2,3\nGauze pads,,3.10,\n')
    rows = R.read_invoice_csv(spark, str(tmp_path / "i.csv")).collect()
    assert [(r.description, r.qty, r.unit_price_cents) for r in rows] == [('Gloves "L", blue', 2.0, 101250), ("Gauze pads", 1.0, 310)]
    lines = spark.createDataFrame([("AB-123 Gloves nitrile 3 $10.00 $30.00",), ("nothing here",)], "line string")
    r = R.parse_invoice_rows(lines).collect()
    assert [(x.sku, x.qty, x.unit_price_cents, x.total_cents) for x in r] == [("AB-123", 3, 1000, 3000)]
    items = spark.createDataFrame([("d", 1, 10.0, 100.0, 20.0, "Blue"), ("d", 1, 32.0, 101.0, 20.0, "gloves"), ("d", 1, 90.0, 100.0, 10.0, "$5"), ("d", 1, 10.0, 80.0, 20.0, "Next")], "doc string, page int, x double, y double, width double, text string")
    assert sorted(x.cells for x in R.invoice_rows(items).collect()) == [["Blue gloves", "$5"], ["Next"]]
    (tmp_path / "d.xml").write_text("<gudid><device><identifiers><identifier><deviceId>00605861017657</deviceId><deviceIdIssuingAgency>GS1</deviceIdIssuingAgency></identifier><identifier><deviceId>D7</deviceId><deviceIdIssuingAgency>HIBCC</deviceIdIssuingAgency></identifier></identifiers><brandName>Max-Cem</brandName><versionModelNumber>AB-12</versionModelNumber><catalogNumber>12</catalogNumber></device></gudid>")
    assert [(x.gtin, x.brand_norm, x.model_norm) for x in R.gudid_devices(spark, str(tmp_path / "d.xml")).collect()] == [("00605861017657", "maxcem", "ab12")]
    (tmp_path / "p.json").write_text(json.dumps({"products": [{"id": 1, "title": "T", "vendor": "V", "variants": [{"id": 2, "sku": "S", "price": "9.99", "available": False}]}]}))
    assert [(x.sku, x.price_cents, x.availability) for x in R.shopify_products(spark, str(tmp_path / "p.json")).collect()] == [("S", 999, "backordered")]
    pages = spark.createDataFrame([(1, '<title>A</title><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"N","sku":"K","offers":[{"price":"12.5"},{"price":"0"}]}]}</script><img src="/logo.png"><img src="/a.jpg">')], "page_id long, html string")
    assert [(x.name, x.sku, x.price_cents) for x in R.json_ld_products(R.html_meta(pages).select("page_id", "json_ld")).collect()] == [("N", "K", 1250)]
    assert R.image_urls(pages).first().images == ["/a.jpg"]
    site = spark.createDataFrame([("<urlset><url><loc> https://x.example/a </loc></url><url><loc><![CDATA[https://x.example/b]]></loc></url></urlset>",)], "xml string")
    assert [x.url for x in R.sitemap_locations(site).collect()] == ["https://x.example/a", "https://x.example/b"]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, S.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, S.update_from(a, b, ["k"], ["v"]).collect())) == [(1, "a"), (2, "B")]
    S.replace(a, str(tmp_path / "t"))
    S.replace(b, str(tmp_path / "t"))
    S.replace(b.limit(1), str(tmp_path / "t"))
    assert S.current(spark, str(tmp_path / "t")).count() == 1 and len(list((tmp_path / "t").glob("tables/rows/*"))) == 2
    with pytest.raises(FileNotFoundError):
        S.current(spark, str(tmp_path / "none"))
    c = spark.createDataFrame([(None, "n"), (2, "Z"), (2, "A")], "k long, v string")
    assert sorted(map(str, S.upsert(a.unionByName(c.where("k IS NULL")), c, ["k"], [F.desc("v")]).collect())) == ["Row(k=1, v='a')", "Row(k=2, v='Z')", "Row(k=None, v='n')"]
    assert S.refresh(spark, {"m2": (["m1"], lambda s: s.table("m1").where("k = 1")), "m1": ([], lambda s: a)}, str(tmp_path)) == ["m1", "m2"]


def test_plan_uses_the_free_threshold():
    import pandas as pd

    offers = pd.DataFrame([(1, 1, 1, 60.0, 100.0, 10.0), (1, 1, 2, 59.0, None, 9.0), (1, 2, 1, 41.0, 100.0, 10.0), (1, 2, 2, 45.0, None, 9.0)], columns=["list_id", "line_no", "supplier_id", "cost", "free_threshold", "flat"])
    out = plan._plan(offers)
    assert set(out.supplier_id) == {1} and out.plan_total[0] == 101.0 and out.cheapest_total[0] == 119.0


def test_plans_against_all_choices(spark):
    """No plan is dearer than the cheapest offers or cheaper than the best of all choices; lists keep all their lines."""
    draw, offers = random.Random(1), []
    for k in range(12):
        for line in range(3):
            for s in draw.sample(range(6), 4 if line else 0 if k == 11 else 3):
                offers.append((k, line, s, round(draw.uniform(5, 60), 2), 80.0 if s % 2 else None, 7.0))
    df = spark.createDataFrame(offers, "list_id long, line_no long, supplier_id long, cost double, free_threshold double, flat double")
    lines = spark.createDataFrame([(k, line) for k in range(12) for line in range(3)], "list_id long, line_no long")
    got = {}
    for r in plan.optimise(lines, df).collect():
        got.setdefault(r.list_id, {})[r.line_no] = r
    for k in range(12):
        cost = {}
        for i, line, s, c, *_ in offers:
            if i == k:
                cost.setdefault(line, {})[s] = c
        policy = {s: (80.0 if s % 2 else None, 7.0) for s in range(6)}
        best = min(plan._Baskets(dict(zip(cost, pick, strict=True)), cost, policy).total() for pick in itertools.product(*cost.values()))
        rows = got[k]
        assert len(rows) == 3 and all((r.supplier_id is None) == (n not in cost) for n, r in rows.items())
        some = next(r for r in rows.values() if r.supplier_id is not None)
        assert best - 1e-6 <= some.plan_total <= some.cheapest_total + 1e-6 and some.plan_total <= best + 3
        kept = plan._Baskets({n: r.supplier_id for n, r in rows.items() if r.supplier_id is not None}, cost, policy).total()
        assert abs(kept - some.plan_total) < 1e-6
    few = {}
    for r in plan.worth_trying(df).collect():
        few.setdefault((r.list_id, r.line_no), {})[r.supplier_id] = r.cost
    for k in range(12):  # the offers left out are in no best plan
        full = {line: {s: c for i, n, s, c, *_ in offers if (i, n) == (k, line)} for line in range(3) if any((i, n) == (k, line) for i, n, *_ in offers)}
        part = {line: few[k, line] for line in full}
        total = lambda cost: min(plan._Baskets(dict(zip(cost, pick, strict=True)), cost, policy).total() for pick in itertools.product(*cost.values()))
        assert abs(total(full) - total(part)) < 1e-9


def test_state_is_the_same_in_any_order(spark):
    rows = [("l", i % 5, f"2024-01-0{1 + i % 7} 00:00:00", i % 3 == 0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "list_id string, item_id long, updated_at string, deleted boolean, payload double")
    whole = sorted(map(tuple, state.merge_lists(None, df).collect()))
    parts = [df.where(f"payload % 3 = {k}") for k in (2, 0, 1)]
    folded = None
    for p in parts:
        folded = state.merge_lists(folded, p)
    assert sorted(map(tuple, folded.collect())) == whole
    assert sorted(map(tuple, state.merge_lists(folded, parts[0]).collect())) == whole  # a batch that comes again


def test_late_writes_revive_nothing(spark):
    """A deletion beyond those handed out stays in the state."""
    gone = [("l", i, f"2024-01-{1 + i % 28:02d} {i // 28:02d}:00:00", True, 0.0) for i in range(150)]
    df = spark.createDataFrame(gone, "list_id string, item_id long, updated_at string, deleted boolean, payload double").withColumn("updated_at", F.to_timestamp("updated_at"))
    late = df.select("list_id", "item_id", (F.col("updated_at") - F.expr("INTERVAL 1 SECONDS")).alias("updated_at"), F.lit(False).alias("deleted"), "payload")
    rows = state.merge_lists(state.merge_lists(None, df), late)
    assert rows.where("NOT deleted").count() == 0 and state.list_view(rows, F.lit("2024-02-01").cast("timestamp")).count() == 100
    assert state.list_view(rows, F.lit("2024-02-20").cast("timestamp")).count() == sum(r[2] >= "2024-01-21" for r in gone)


def test_stored_packs(spark):
    from shelfmark.functions import axes as A

    cases = [
        ("200/Box", "", 200, "box", "each"), ("20 - 0.2g Capsules", "", 20, "pack", "each"), ("24x1.2mL Syringe", "", 24, "pack", "each"), ("Pkg of 10", "", 10, "pack", "each"),
        ("Case of 10", "", 10, "case", "each"), ("10 x 100", "", 1000, "case", "each"), ("", "Gauze (Pkg. 200)", 200, "pack", "each"), ("60/Can x 12/Case", "", 720, "case", "each"), ("Jar 50gm", "", 50, "each", "g"),
    ]
    got = _one(spark, *[P.parse_pack(F.lit(p), F.lit(n)) for p, n, *_ in cases])
    assert [(int(g.pack_quantity), g.basis, g.base_unit) for g in got] == [tuple(c[2:]) for c in cases]
    assert _one(spark, P.parse_pack(F.lit("Set-up Tray Box 3 System"), F.lit("")))[0] is None


def test_label_text(spark):
    from shelfmark.functions import axes as A

    x = _one(spark, A.lot_and_expiry(F.lit("LOT: AB123 EXP 2027-04")), A.catalog_refs(F.lit("REF 45-A1 code AB1234")), A.decode_entities(F.lit("3M&trade;  Tape &amp; Co - Blue - Blue")))
    assert (x[0].lot, str(x[0].expiry)) == ("AB123", "2027-04-30") and x[1] == ["45-A1", "AB1234"] and x[2] == "3M™ Tape & Co - Blue"


def test_decoding_and_leads(spark):
    from shelfmark.functions import ingest_text as I

    raw = spark.createDataFrame([(1, bytearray("größe".encode("windows-1252")), None), (2, bytearray("größe".encode()), None), (3, bytearray(b'<meta charset="latin-1">\xe9'), None), (4, None, "x")], "id long, body binary, charset string")
    assert {r.id: r.text for r in I.decode_pages(raw).collect()} == {1: "größe", 2: "größe", 3: '<meta charset="latin-1">é', 4: None}
    assert _one(spark, I.classify_lead(F.lit("Dental supply catalog: add to cart")), I.classify_lead(F.lit("hello"))) == [("supplier", 100), ("unknown", 10)]


def test_product_names_are_mended(spark):
    from shelfmark.functions import axes as A

    cases = {
        "Nitrile?Gloves": "Nitrile Gloves", "ProNamel? Toothpaste": "ProNamel Toothpaste", "Jackets?10Pk": "Jackets 10Pk", "Size 6 ?, blue": "Size 6, blue", " .04 Taper": ".04 Taper", "What?": "What", "": "",
        "HSB - Nitrile Gloves, Blue, X-Large 100/Bx - Blue / X-Large / 100/Bx": "HSB - Nitrile Gloves, Blue, X-Large 100/Bx", "Gauze - Each": "Gauze - Each", "Gauze Blue - Blue / Red": "Gauze Blue - Blue / Red", "A / B - a / b": "A / B",
    }
    assert _one(spark, *[A.clean_product_name(F.lit(c)) for c in cases]) == list(cases.values())
    assert _one(spark, *[A.clean_product_name(F.lit(c)) for c in cases.values()]) == list(cases.values())


@pytest.mark.parametrize("size", ["37b", "200b", "128m"])
def test_csv_in_splits(spark, tmp_path, size):
    """A file is cut anywhere, inside quotes too, and reads as it does whole."""
    draw = random.Random(5)
    cell = lambda: draw.choice(["", "plain", "two words", 'say ""so""', "a,b", "line\none", "l\n\nm", '""', "\r\n", "x" * 60, "größe"])
    text = '"the\nname",b,c\n' + "".join(",".join(f'"{cell()}"' if draw.random() < 0.7 else str(k) for k in range(3)) + draw.choice(["\n", "\r\n", "\n\n"]) for _ in range(120))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text, newline="")
    (tmp_path / "in" / "b.csv").write_text('"the\nname",b,c\n1,"2\n3",4', newline="")
    plain = spark.read.csv(str(tmp_path / "in"), header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    want = sorted((tuple(r) for r in plain.collect() if any((x or "").strip() for x in r)), key=str)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert sorted(map(tuple, R.read_csv(spark, str(tmp_path / "in")).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_csv_records_are_put_together_where_they_are_read(spark, tmp_path, monkeypatch):
    """Texts are written once and not brought together by key, in whatever batches a task gets its lines."""
    draw = random.Random(3)
    cells = [[f"{i}", "\n".join(draw.choices(["", "a,b", 'say "so"', "line"], k=draw.randint(1, 9)))] for i in range(150)]
    text = "id,t\n" + "".join(i + ',"' + t.replace('"', '""') + '"\n' for i, t in cells)
    (tmp_path / "a.csv").write_text(text, newline="")
    saved, real = [], R.saver
    monkeypatch.setattr(R, "saver", lambda s: lambda df: saved.append(df.columns) or real(s)(df))
    conf = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        records = R.csv_records(spark, str(tmp_path)).orderBy("record").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [(r.record, r.text) for r in records] == [(0, "id,t"), *[(n, i + ',"' + t.replace('"', '""') + '"') for n, (i, t) in enumerate(cells, 1)]]
    assert sum("text" in columns for columns in saved) == 1


def test_sample_is_the_plain_shuffle(spark):
    from shelfmark.operators import reports

    for n, count, seed in ((1, 5, 42), (2, 2, 7), (137, 20, 42), (20_000, 200, 42)):
        items, state_ = list(range(n)), float(seed)
        for i in range(n - 1, 0, -1):
            state_ = (state_ * 1103515245 + 12345) % 2147483648.0
            j = int(state_ / 2147483648.0 * (i + 1))
            items[i], items[j] = items[j], items[i]
        df = spark.range(n).withColumn("id", F.col("id") * 3).repartition(3)
        assert [(r.place, r.id) for r in reports.sample(df, [F.col("id")], count, seed).orderBy("place").collect()] == [(k, 3 * x) for k, x in enumerate(items[:count])]


def test_supplier_pairs_in_pieces(spark):
    from shelfmark.operators import reports

    draw = random.Random(2)
    offers = [(p, s) for p in range(40) for s in draw.sample(range(30), draw.choice([0, 1, 2, 9, 30]))] + [(None, 1), (3, None)]
    df = spark.createDataFrame(offers * 2, "product_id long, supplier_id long")
    want = {}
    for p in range(40):
        own = sorted({s for q, s in offers if q == p and s is not None})
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for block in (200, 7, 1):
        assert {(r.supplier_a, r.supplier_b): r.n_products for r in reports.supplier_pairs(df, block).collect()} == want


def test_option_lists_and_anchors(spark):
    from shelfmark.operators import lists

    rows = [("a", 0, "808 ga - 5/Pk"), ("a", 1, "808 GA - 5/Pkg"), ("a", 2, "900 ga"), ("a", 3, ""), ("b", 0, "S - 5/Bx"), ("b", 1, "S - 9/Box"), ("b", 2, "S - 9/bx"), ("c", 0, "10/Box")]
    got = sorted(map(tuple, lists.variant_options(spark.createDataFrame(rows, "family string, position int, label string")).collect()))
    assert got == [("a", 0, "808 ga", [0, 1]), ("a", 1, "900 ga", [2]), ("a", 2, "Option 4", [3]), ("b", 0, "S - 5/Bx", [0]), ("b", 1, "S - 9/Box", [1, 2]), ("c", 0, "10/Box", [0])]
    products = spark.createDataFrame([(1, "Nitrile Exam Gloves Large"), (2, "Nitrile Exam Gloves"), (3, "Exam"), (4, "Nitrile exam gloves"), (5, "Dental Mirror")], "id int, name string")
    seeds = spark.createDataFrame([(1, "Dental nitrile exam gloves"), (2, "disposable mirror"), (3, "nothing like it"), (4, "")], "id int, text string")
    assert sorted(map(tuple, lists.best_anchors(seeds, products).collect())) == [(1, 3, 100), (2, 5, 50), (3, 3, 0), (4, 3, 0)]
    assert lists.best_anchors(seeds, products.where("false")).count() == 0


def test_versions_keep_what_they_captured(spark):
    from shelfmark.operators import lists

    v = spark.createDataFrame([(1, "f", "pending", None), (2, "g", "accepted", "x")], "id int, file_name string, status string, captured_by string")
    patch = lambda *r: spark.createDataFrame(list(r), "id int, status string, file_name string, captured_by string")
    assert sorted(map(tuple, lists.apply_status_updates(v, patch((1, "accepted", "f", None), (9, "x", "y", "z"))).collect())) == [(1, "f", "accepted", None), (2, "g", "accepted", "x")]
    with pytest.raises(Exception, match="file_name is immutable"):
        lists.apply_status_updates(v, patch((1, "accepted", "other", None))).collect()
    with pytest.raises(Exception, match="captured_by is immutable"):
        lists.apply_status_updates(v, patch((2, "accepted", "g", None))).collect()


def test_digits_of_a_code_are_no_quantity(spark):
    lines = ["AB-7720 blue ring 3 bx $68.45 $532,385.65", "7720 blue ring 3 bx $68.45 $528,434.00", "AB-40 ring 40 bx $1.00 $40.00"]
    r = R.parse_invoice_rows(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(x.sku, x.qty) for x in r] == [("AB-7720", None), ("7720", 7720), ("AB-40", 40)]


def test_cells_of_a_row_are_made_within_it(spark):
    draw = random.Random(5)
    items = [(d, p, round(draw.uniform(0, 300), 1), draw.choice([700.0, 698.0, 650.0, 640.0]), 12.0, f"t{d}{p}{k}") for d in range(3) for p in range(2) for k in range(14)]
    want = []
    for d in range(3):
        for p in range(2):
            rows, last = [], None
            for _, _, x, y, w, t in sorted((i for i in items if i[:2] == (d, p)), key=lambda i: (-i[3], i[2])):
                if last is None or last - y > 3.0:
                    rows.append([])
                rows[-1].append((x, t, w))
                last = y
            for row in rows:
                cells, end = [], None
                for x, t, w in sorted(row):
                    if end is None or x - end > 8.0:
                        cells.append([])
                    cells[-1].append(t)
                    end = x + w
                want.append((d, p, [" ".join(c) for c in cells]))
    got = R.invoice_rows(spark.createDataFrame(items, "doc int, page int, x double, y double, width double, text string"))
    assert sorted((r.doc, r.page, r.cells) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # items are gathered once
