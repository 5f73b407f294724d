"""Operators whose results must not depend on how common a word or key is: held against brute force."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from shelfmark.functions import axes as A, text as T
from shelfmark.operators import class_clusters, matching as M, matching_queries, name_classes as N, overlap, plan, reports, search, top_names
from shelfmark.plans import registry
from shelfmark.session import saver, spread


def test_overlap_join_keeps_common_words(spark):
    words = {i: ["common", "often" if i % 2 else "else", "often" if i % 3 else "third", f"w{i % 40}", None] for i in range(700)}
    df = spark.createDataFrame(list(words.items()), "id long, words array<string>")
    sets = {i: {w for w in ws if w} for i, ws in words.items()}
    left = [i for i in words if i % 20 == 1]
    for least in (1, 2, 3):
        want = {(a, b, n) for a in left for b in words if (n := len(sets[a] & sets[b])) >= least}
        for block in (600, 7):
            got = search.overlap_join(df.where("id % 20 = 1"), df, least, block).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_invoice_names_match_by_common_words(spark):
    listings = spark.createDataFrame([(i, 1, f"L{i}", f"blue bracket style{i} kit") for i in range(700)] + [(900, 1, "L900", "blue bracket style7 kit")], "listing_id long, supplier_id long, sku string, name string")
    lines = spark.createDataFrame([("near", 9, None, "blue bracket styles7"), ("equal", 9, None, "blue bracket style7 kit"), ("turned", 9, None, "bracket blue style7 kit"), ("far", 9, None, "green wire")], "line_id string, supplier_id long, sku string, description string")
    got = {r.line_id: (r.listing_id, r.match_status, r.confidence) for r in search.match_invoice_lines(lines, listings).collect()}
    assert got["equal"] == (7, "needs_review", 70) and got["far"] == (None, "unmatched", 0)

    grams = lambda t: {f"  {t} "[i : i + 3] for i in range(len(t) + 1)}

    def sim(x: str, y: str) -> float:
        a, b, g, h = {*x.split()}, {*y.split()}, grams(x), grams(y)
        return 0.45 * len(a & b) / len(a | b) + 0.55 * 2 * len(g & h) / (len(g) + len(h))

    names = {r.listing_id: r.name for r in listings.collect()}
    for r in lines.where("line_id IN ('near', 'turned')").collect():
        best = min(names, key=lambda i: (-sim(r.description, names[i]), i))
        assert got[r.line_id] == (best, "needs_review", int(40 + 30 * sim(r.description, names[best]) + 0.5))


def _features(spark, n: int, sku: str, name: str):
    rows = [(i, str(i), sku.format(i), "Acme", name.format(i), "10/Box") for i in range(n)]
    return M.features(spark.createDataFrame(rows, "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string"))


def test_long_posting_lists_make_all_their_pairs(spark):
    f = _features(spark, 130, "AB1234", "Fine Paper Point")
    want = {(a, b) for b in range(130) for a in range(b)}
    for block in (600, 50):
        got = M.candidate_pairs(M.blocking_index(f), block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    save = saver(spark)
    f = save(f)
    scored = save(M.score_pairs(M.candidate_pairs(M.blocking_index(f)), f))
    assert scored.count() == len(want) and {r.cluster for r in M.clusters(scored, f, save).collect()} == {0}


def test_common_words_are_indexed(spark):
    keys = M.blocking_index(_features(spark, 650, "", "Fine Paper Point{}")).groupBy("key").count().where("count > 600")
    assert [r.key for r in keys.collect()] == ["words:acme:fine:paper"]


def test_name_brand_probe(spark):
    """Pairs of one brand and different suppliers by likeness, in groups; long lists keep all their pairs."""
    f = _features(spark, 130, "", "Fine Paper Point")
    save = saver(spark)
    got = N.name_brand_probe(save(f), save).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(a, b) for b in range(130) for a in range(b)} and {(r.high, r.group) for r in got} == {(True, 0)}
    rows = [(1, "a", "", "Acme", "Fine Paper Point Large"), (2, "b", "", "Acme", "Fine Paper Point Small"), (3, "b", "", "Other", "Fine Paper Point Large"), (4, "a", "", "Acme", "Fine Paper Points Large"), (5, "c", "", "Acme", "Fine Paper Point Holder Large Kit Blue")]
    f = save(M.features(spark.createDataFrame([(*r, "") for r in rows], "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string")))
    got = {(r.left_id, r.right_id): r for r in N.name_brand_probe(f, save, 0.5, 0.9).collect()}
    assert set(got) == {(1, 5), (4, 5)} and not any(r.high for r in got.values())


def _catalog(spark):
    """Listings that repeat names, packs and codes, short and weak codes and codes in names among them."""
    draw = random.Random(4)
    words = ["glove", "nitrile", "exam", "textured", "small", "large", "paper", "point", "fine", "bur", "diamond", "kit", "25", "30", "#15", "K3XF12345", "AB9871", "AB98765X"]
    names = [" ".join(draw.sample(words, draw.randint(1, 6))) for _ in range(40)]
    codes = ["", "0044", "12", "AB9871", "AB98765X", "8234155", "823-4155", "0000", "K3XF12345", "DOCP12", "4302", "219-4302"]
    rows = [(i, draw.choice(["msup_dentalcity_com", "msup_dcdental_com", "b", "c"]), draw.choice([*codes, f"Z{i // 2}00{i // 2}Q"]), draw.choice(["Acme", "Acme", "Acme Best", "Kerr", ""]), draw.choice(names), draw.choice(["", "10/Box", "25/Box", "100/Box"])) for i in range(420)]
    return M.features(spark.createDataFrame(rows, "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string"))


def test_classes_score_as_pairs_do(spark, data):
    save = saver(spark)
    for f, least in ((_catalog(spark), 1000), (M.features(matching_queries.listings(spark, data)), 20)):
        f = save(f)
        plain = save(M.score_pairs(M.candidate_pairs(M.blocking_index(f)), f)).where("status <> 'reject'").collect()
        got = save(N.score_by_classes(f, save)).collect()
        assert len(got) == len(plain) >= least and {tuple(r) for r in got} == {tuple(r) for r in plain}
        # the probe's pairs, by its own rule
        own = M._signals(M.candidate_pairs(M.blocking_index(f).where("key LIKE 'words:%'")), f).where("left.supplier_id <> right.supplier_id AND brand = 'match' AND NOT loosely AND n >= 0.7").where(~A.axes_conflict(F.col("left.axes"), F.col("right.axes")))
        assert {(r.left_id, r.right_id) for r in own.select("left_id", "right_id").collect()} == {(r.left_id, r.right_id) for r in N.name_brand_probe(f, save).collect()}
        # classes stand for the pairs that share no code
        codes = {r.listing_id: {c for c in (r.code, r.core, *r.name_codes) if c} for r in f.collect()}
        want = sum(not codes[r.left_id] & codes[r.right_id] for r in plain)
        links = N.link_classes(f, save).collect()
        assert sum(r.n_links for r in links) == want and len({(r.left_class, r.right_class) for r in links}) == len(links) <= want


def test_similar_sets(spark):
    draw = random.Random(3)
    sets = {i: sorted({"supplier", *(f"w{draw.randrange(12)}" for _ in range(draw.randrange(1, 7)))}) for i in range(150)}
    left = spark.createDataFrame(list(sets.items()), "left_set long, left_words array<string>")
    for least in (0.5, 0.8):
        want = {(a, b, round(j, 9)) for a in sets for b in sets if (j := len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})) >= least}
        got = overlap.similar_sets(left, left.withColumnsRenamed({"left_set": "right_set", "left_words": "right_words"}), least).collect()
        assert len(got) == len(want) and {(r.left_set, r.right_set, round(r.likeness, 9)) for r in got} == want


def test_vendor_names_contain(spark):
    names = spark.createDataFrame(list(enumerate(["Abc", "the ABC corp of long names", "bc", "xyz", "", None, "longnames co"])), "id int, name string")
    suppliers = spark.createDataFrame([(1, "Abc Corp"), (2, "abc"), (3, "B"), (4, "of long names company"), (5, "")], "id int, name string")
    assert {tuple(r) for r in search.vendor_contains(names, suppliers, 4).collect()} == {(0, 2), (1, 1), (2, 1)} | {(6, 4)}


def test_fuzzy_search_compares_every_name(spark, data):
    got = search.q15_fuzzy_search(spark, data).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("l")).collect()
    p = spark.read.parquet(f"{data}/part.parquet")
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q_id"), T.tokenize_name(F.concat(F.substring("p_name", 1, 6), F.lit(" "), F.lower("p_type"))).alias("q"))
    scored = q.crossJoin(search._products(spark, data).withColumn("p", T.tokenize_name("name"))).select("q_id", "id", "priced", F.round(T.name_similarity("q", "p"), 9).alias("s")).where("s >= 0.12").collect()
    want = {}
    for r in scored:
        want.setdefault(r.q_id, []).append((not r.priced, -r.s, r.id))
    assert {r.query_id: [(x.product_id, x.score) for x in r.l] for r in got} == {k: [(i, -s) for _, s, i in sorted(v)[:10]] for k, v in want.items()}


def test_searches_stay_exact_when_lists_are_passed_over(spark, monkeypatch):
    """The floors of the first look and the bounds, against every query beside every name."""
    draw = random.Random(8)
    words = ["glove", "gloves", "nitrile", "exam", "ex", "e", "paper", "points", "fine", "large", "x", "25mm", "kit", "blue"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 6))), draw.random() < 0.6) for i in range(900)]
    products = spark.createDataFrame(rows, "id long, name string, priced boolean")
    queries = spark.createDataFrame([(i, " ".join(draw.choices([*words, "unknown", "glo", "pap"], k=draw.randint(0, 4)))) for i in range(60)], "id long, text string")
    every = queries.select(F.col("id").alias("query_id"), T.tokenize_name("text").alias("q")).crossJoin(products.select("id", "priced", T.tokenize_name("name").alias("p")))
    every = every.withColumn("s", F.round(T.name_similarity("q", "p"), 9)).where("s >= 0.12").collect()
    for units, names, limit in ((8, 64, 10), (1, 2, 3), (30, 900, 3)):
        monkeypatch.setattr(top_names, "UNITS", units)
        monkeypatch.setattr(top_names, "NAMES", names)
        want = {}
        for r in every:
            want.setdefault(r.query_id, []).append((not r.priced, -r.s, r.id))
        got = search.fuzzy_search(queries, products, 0.12, limit).collect()
        assert {(r.query_id, r.rank, r.product_id, r.score) for r in got} == {(q, k, i, -s) for q, v in want.items() for k, (_, s, i) in enumerate(sorted(v)[:limit], 1)}
    # substitutes: priced products that have one of the three longest words
    got = {(r.query_id, r.rank, r.product_id) for r in search.substitutes_for(queries, products).collect()}
    want = {}
    for r in every:
        long = sorted({w: -len(w) for w in reversed(r.q) if len(w) >= 3 and any(c.isalpha() for c in w)}.items(), key=lambda x: (x[1], r.q.index(x[0])))[:3]
        if r.priced and any(w in " ".join(r.p) for w, _ in long):
            want.setdefault(r.query_id, []).append((-r.s, r.id))
    assert got == {(q, k, i) for q, v in want.items() for k, (_, i) in enumerate(sorted(v)[:3], 1)}


def test_containing(spark):
    draw = random.Random(9)
    words = ["common"] * 6 + ["often"] * 3 + [f"w{i}" for i in range(30)]
    sets = {f"n{i}": draw.choices(words, k=draw.randint(1, 6)) for i in range(300)}
    asked = {f"q{i}": draw.choices([*words, "absent"], k=draw.randint(1, 7)) for i in range(80)}
    names, queries = (spark.createDataFrame(list(x.items()), s) for x, s in ((sets, "name string, p array<string>"), (asked, "query string, q array<string>")))
    for least in (0.34, 0.6, 1.0):
        want = {(q, n) for q, ws in asked.items() for n, p in sets.items() if sum(w in p for w in ws) / len(ws) >= least}
        got = top_names.containing(queries, names, least).collect()
        assert len(got) == len(want) and {(r.query, r.name) for r in got} == want


def test_evidence_pools(spark):
    """A supplier's product promotes its kind, a shelf item its place; weights join as independent signals."""
    s = "signal_id int, sku string, manufacturer_sku string, barcode string, product_name string, lot_number string, expiration_date date, location_hint string"
    signals = spark.createDataFrame([(1, "DCG30-UNI", None, None, "Cameron Elevator", "L-1", None, None), (2, None, None, None, None, None, None, "store room"), (3, "", None, "", "zzz", "", None, None)], s)
    products = spark.createDataFrame([("msp_1", "dcg30uni", "", "", "Elevator Cameron large", "mcp_1"), ("msp_2", "99", "", "", "Gauze", "mcp_2")], "id string, sku string, manufacturer_sku string, barcode string, name string, canonical_id string")
    kinds = spark.createDataFrame([("mcp_1", "Elevator"), ("mcp_2", "Gauze")], "id string, name string")
    shelf = spark.createDataFrame([("i1", "loc1", "Elevator", None, "l1", None)], "id string, location_id string, name string, barcode string, lot_number string, expiration_date date")
    places = spark.createDataFrame([("loc1", "Room 4", "op"), ("loc2", "Store room", "storage")], "id string, name string, type string")
    got = {(r.signal_id, r.target_id): (r.strength, r.score, r.n_reasons, r.rank) for r in search.rank_evidence(signals, products, kinds, shelf, places).collect()}
    sp = 1 - 0.05 * 0.45
    item = 1 - 0.3 * 0.7
    want = {(1, "msp_1"): ("strong", sp, 2, 1), (1, "mcp_1"): ("strong", 1 - (1 - sp) * 0.7, 2, 2), (1, "i1"): ("possible", item, 2, 3), (1, "loc1"): ("possible", item * 0.85, 1, 4), (2, "loc2"): ("possible", 0.72, 1, 1), (2, "loc1"): ("possible", 0.42, 1, 2)}
    want[2, "loc1"] = ("weak", 0.42, 1, 2)
    want[1, "mcp_1"], want[1, "msp_1"] = (*want[1, "mcp_1"][:3], 1), (*want[1, "msp_1"][:3], 2)
    assert set(got) == set(want)
    for k, (strength, score, n, rank) in want.items():
        assert got[k][0] == strength and abs(got[k][1] - score) < 1e-6 and got[k][2:] == (n, rank), k


def test_evidence_is_counted_as_it_is_ranked(spark):
    """Counts by agreements are those of the ranked pairs, for copies, missing fields and codes that agree in two ways."""
    draw = random.Random(8)
    some = lambda values, none=0.3: None if draw.random() < none else draw.choice(values)
    words, codes = ["blue", "ring", "steel", "plate", "small", "x"], ["AB-1", "ab1", "77", "CD234567", "123456", "111", ""]
    text = lambda: " ".join(draw.choices(words, k=draw.randint(0, 4)))
    bars, lots, days = ["0012", "12", "99", ""], ["L1", "l-1", "L2", ""], ["2024-02-01", "2024-02-02"]
    code = "id int, sku string, manufacturer_sku string, barcode string"
    signals = spark.createDataFrame([(i, some(codes), some(codes), some(bars), some([text()]), some(lots), some(days), some(["room one", "store", "op two three", text()])) for i in range(90)], "signal_id int, sku string, manufacturer_sku string, barcode string, product_name string, lot_number string, expiration_date string, location_hint string")
    signals = signals.unionByName(signals.withColumn("signal_id", F.col("signal_id") + 90))
    products = spark.createDataFrame([(i, some(codes), some(codes), some(bars), some([text()]), some(["k1", "k2", "k3", "gone"])) for i in range(120)], code + ", name string, canonical_id string")
    kinds = spark.createDataFrame([(f"k{i}", text()) for i in range(1, 9)], "id string, name string")
    shelf = spark.createDataFrame([(i, draw.randint(1, 5), some([text()]), some(bars), some(lots), some(days)) for i in range(150)], "id int, location_id int, name string, barcode string, lot_number string, expiration_date string")
    places = spark.createDataFrame([(1, "Room one", "op"), (2, "Store", None), (3, "two", "three"), (4, "", "store")], "id int, name string, type string")
    ranked = search.rank_evidence(signals, products, kinds, shelf, places).collect()
    want = {}
    for r in ranked:
        n = want.setdefault(r.signal_id, {})
        for c, k in ((f"n_{r.strength}", 1), ("n_reasons", r.n_reasons), (f"n_{r.target_type}s", 1)):
            n[c] = n.get(c, 0) + k
    assert len(ranked) > 5000
    got = [r.asDict() for r in search.count_evidence(signals, products, kinds, shelf, places).collect()]
    assert sorted(r["signal_id"] for r in got) == list(range(180))
    for r in got:
        n = want.get(r["signal_id"], {})
        assert {c: v for c, v in r.items() if c.startswith("n_") and v} == n, r
        assert r["status"] == ("ok" if n.get("n_strong", 0) + n.get("n_possible", 0) else "needs_manual_review")
        assert r["class_id"] <= r["signal_id"] % 90


def test_substitutes_by_words(spark):
    rows = [(1, ["fine", "paper", "point"], ["acme"], {"size": ["L"]}, 100, 2), (2, ["fine", "paper", "point", "kit"], ["best"], {"size": ["L"]}, 60, 1), (3, ["fine", "paper", "point"], ["best"], {"size": ["S"]}, 50, 1), (4, ["fine", "paper", "point"], ["acme"], {}, 40, 1), (5, ["fine", "hat"], ["best"], {}, 10, 1), (6, ["paper", "point"], [], {}, 99, 1)]
    got = M.substitutes(spark.createDataFrame(rows, "id int, words array<string>, brand_words array<string>, axes map<string,array<string>>, unit_price int, n_suppliers int")).collect()
    assert [(r.id, r.substitute_id, round(r.likeness, 6), r.saving, r.rank) for r in got] == [(1, 2, 0.75, 40, 1), (1, 6, round(2 / 3, 6), 1, 2)]


def test_families_and_orphans(spark):
    """A size ladder is one family; a verbose listing without a brand joins it with a new size, not with one it has."""
    names = [("a", "G1S", "Best", "Nitrile Exam Glove Textured Small"), ("a", "G1M", "Best", "Nitrile Exam Glove Textured Medium"), ("b", "Q9", "", "Best Nitrile Exam Glove Textured Fingertip Purple Extra Large"), ("b", "Q7", "", "Best Nitrile Exam Glove Textured Fingertip Blue Small")]
    f = M.features(spark.createDataFrame([(i, s, sku, b, n, "") for i, (s, sku, b, n) in enumerate(names)], "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string"))
    members = f.select("listing_id", F.col("listing_id").alias("cluster"))
    got = {r.cluster: (r.family, r.label) for r in M.families(members, saver(spark)(f), saver(spark)).collect()}
    assert set(got) == {0, 1, 2} and len({k for k, _ in got.values()}) == 1 and [got[i][1] for i in range(3)] == ["Small", "Medium", "X-Large"]


def test_orphans_choose_one_after_the_other(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    groups = []
    for k in range(24):
        model = sorted(draw.sample(words, draw.randint(2, 4)))
        brand, axis = draw.choice(["", "acme", "best"]), draw.choice(["size", "shade"])
        for value in draw.sample("abcdefgh", draw.choice([2, 2, 3, 4])):
            groups.append((1000 + len(groups), f"f{k:02d}", brand, model, model, axis, value))
    for k in range(160):
        core = sorted(draw.sample(words, draw.randint(3, 8)))
        groups.append((k, f"o{k:03d}", draw.choice(["", "acme", "best"]), core, core, draw.choice(["size", "shade"]), draw.choice("abcdefgh")))
    members = {}
    for g in groups:
        members.setdefault(g[1], []).append(g)
    size, want = {f: len(m) for f, m in members.items()}, {}
    values = {f: {g[6] for g in m} for f, m in members.items()}
    for o in sorted(g for g in groups if size[g[1]] == 1):
        for f in sorted((f for f in size if size[f] >= 2), key=lambda f: (-size[f], f)):
            t = members[f][0]
            if t[5] == o[5] and (t[2] == o[2] or "" in (t[2], o[2])) and len(t[3]) >= 3 and set(t[3]) <= set(o[4]) and o[6] not in values[f]:
                values[f].add(o[6])
                want[o[0]] = f
                break
    df = spark.createDataFrame(groups, "cluster long, family string, brand string, model array<string>, core_words array<string>, axis string, value string")
    got = {r.cluster: r.into for r in M.bridge_orphans(df, saver(spark)).collect()}
    assert got == want and len(want) > 40


def test_invoice_match_reads_every_line(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("line_id")).distinct()
    got = search.q21_invoice_match(spark, data).select("line_id")
    assert got.count() == lines.count() and lines.join(got, "line_id", "left_anti").isEmpty()


def test_lookups_make_no_pairs_that_they_drop(spark, data, tmp_path):
    """q18 and q19 on tables with keys given twice, nulls and many parts of one name: rows as by their SQL; q18 shuffles no
    pairs to find the distinct ones, q19 ranks a name's parts before they meet."""
    part = spark.read.parquet(f"{data}/part.parquet").where("p_partkey < 120")
    twice = part.where("p_partkey % 7 = 0").withColumn("p_name", F.concat("p_name", F.lit(" x")))
    odd = part.withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, "p4").when(F.col("p_partkey") % 3 > 0, "hot bolt").when(F.col("p_partkey") % 11 > 0, F.col("p_name"))).withColumn("p_type", F.lit("SMALL"))
    odd.unionByName(twice).withColumn("p_brand", F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).otherwise("House")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for t in ("lineitem", "supplier"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("q18_reference_lookup", "q19_substitutes"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = registry.catalog.run(spark, str(tmp_path), registry.readmodels.QUERIES[name])
        assert got.count() > 50 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "dense_rank" in plan if name.startswith("q19") else not plan.lstrip().startswith("Aggregate")



def test_rows_of_a_small_file_are_many_tasks(spark, data):
    """Long work for each row is spread, though the file is one split; scans of many splits stay as they are."""
    n = 4 * spark.sparkContext.defaultParallelism
    for name in ("f19_name_similarity", "c29_selector", "c28_axis_values", "f06_brands_agree", "f15_sku_evidence", "c02_gtin_variants", "er03_blocking_index"):
        assert registry.queries()[name](spark, data).rdd.getNumPartitions() >= n, name
    many = spark.range(0, 100, 1, n + 3)
    assert spread(many) is many


def test_links_are_counted_as_pairs_are(spark, data):
    save = saver(spark)
    for f in (_catalog(spark), M.features(matching_queries.listings(spark, data))):
        f = save(f)
        want = {r.listing_id: [0, 0, 0] for r in f.select("listing_id").collect()}
        for r in N.score_by_classes(f, save).collect():
            for i in (r.left_id, r.right_id):
                want[i][("exact", "variant", "needs_review").index(r.status)] += 1
        got = N.link_counts(f, save).collect()
        assert len(got) == len(want) and {r.listing_id: [r.n_exact, r.n_variant, r.n_review] for r in got} == want and all(r.n_links == sum(want[r.listing_id]) for r in got)


def test_probe_groups_are_those_of_its_pairs(spark, data):
    save = saver(spark)
    for f in (_catalog(spark), M.features(matching_queries.listings(spark, data))):
        f = save(f)
        want = {r.listing_id: [0, 0, None] for r in f.select("listing_id").collect()}
        for r in N.name_brand_probe(f, save).collect():
            for i in (r.left_id, r.right_id):
                want[i] = [want[i][0] + 1, want[i][1] + r.high, r.group if r.high else want[i][2]]
        got = N.name_brand_groups(f, save).collect()
        assert len(got) == len(want) and {r.listing_id: [r.n_links, r.n_high, r.group] for r in got} == want


def test_clusters_by_classes_are_whole(spark, data):
    """Listings of a cluster agree in every bound that two of them state and are linked; no accepted pair is left open."""
    save = saver(spark)
    blank = _catalog(spark).withColumn("code", F.when(F.col("listing_id") % 3 > 0, F.col("code")).otherwise(""))
    for f, least in ((_catalog(spark), 30), (blank, 30), (M.features(matching_queries.listings(spark, data)), 3)):
        f = save(f)
        scored = save(N.score_by_classes(f, save))
        links = [(r.left_id, r.right_id) for r in scored.where("status IN ('exact', 'variant')").collect()]
        bounds = {r.id: {k: set(v) for k, v in r.bounds.items()} for r in M._bounds(f).collect()}
        rows = class_clusters.clusters_by_classes(f, save).collect()
        got = {r.listing_id: r.cluster for r in rows}
        assert len(rows) == len(got) == len(bounds)
        members, stated = {}, {}
        for i, c in got.items():
            members.setdefault(c, []).append(i)
            for k, v in bounds[i].items():
                stated.setdefault(c, {}).setdefault(k, []).append(v)
        common = {c: {k: set.intersection(*v) for k, v in b.items()} for c, b in stated.items()}
        assert all(v for b in common.values() for v in b.values()) and all(min(m) == c for c, m in members.items())
        root = {i: i for i in got}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            if got[a] == got[b]:
                root[top(a)] = top(b)
            else:
                x, y = common.get(got[a], {}), common.get(got[b], {})
                assert any(not x[k] & y[k] for k in x.keys() & y.keys()), (a, b)
        assert all(len({top(i) for i in m}) == 1 for m in members.values())
        assert sum(len(m) > 1 for m in members.values()) >= least


def test_copies_make_no_pairs_of_clusters(spark):
    """Eight times the copies of a name, of four suppliers, are clusters of four each, by no more rounds or links."""
    sizes = []
    for n in (40, 320):
        rows = [(i, "abcd"[i % 4], f"QX{i}77Z", "Acme", "Fine Paper Point", "10/Box") for i in range(n)]
        f = M.features(spark.createDataFrame(rows, "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string"))
        save, written = saver(spark), []

        def counted(df, save=save, written=written):
            out = save(df)
            written.append(out)
            return out

        got = class_clusters.clusters_by_classes(counted(f), counted).groupBy("cluster").count().collect()
        assert len(got) == n // 4 and {r["count"] for r in got} == {4}
        sizes.append((len(written), max(df.count() for df in written)))
    assert sizes[1][0] == sizes[0][0] and sizes[1][1] <= 320


def test_lists_are_planned_in_batches(spark, data):
    """Many lists go to a Python call; each has the plan that it has alone."""
    draw = random.Random(2)
    offers = [(k, n, s, round(draw.uniform(1, 30), 2), draw.choice([None, 40.0]), draw.choice([None, 9.95])) for k in range(30) for n in range(draw.randint(1, 5)) for s in draw.sample(range(8), 4)]
    policy = {s: (f, x) for *_, s, _, f, x in offers}
    offers = [(k, n, s, c, *policy[s]) for k, n, s, c, *_ in offers]
    df = spark.createDataFrame(offers, "list_id long, line_no long, supplier_id long, cost double, free_threshold double, flat double")
    out = plan.optimise(df, df)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    rows = plan.worth_trying(df).toPandas()
    want = {tuple(r) for k in range(30) for r in plan._plan(rows[rows.list_id == k]).itertuples(index=False)}
    got = out.select(*plan.NAMES).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_substitutes_of_copies_are_ranked_once(spark, data):
    """Every product's cheaper ones against brute force; copies share a ranking, and features are planned once."""
    draw = random.Random(5)
    names = [sorted(draw.sample(["fine", "paper", "point", "kit", "blue"], draw.randint(1, 4))) for _ in range(6)]
    rows = [(i, draw.choice(names), draw.choice([["acme"], ["best"], []]), draw.choice([{}, {"size": ["L"]}, {"size": ["S"]}]), draw.randint(1, 40), draw.randint(1, 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, words array<string>, brand_words array<string>, axes map<string,array<string>>, unit_price int, n_suppliers int")
    want = set()
    for i, w, b, x, u, n in rows:
        met = [(v, j) for j, y, c, z, v, _ in rows if v < u and len({*w} & {*y}) / len({*w} | {*y}) >= 0.5 and (b != c or not b) and (not x or not z or x == z)]
        want |= {(i, j, u - v, k) for k, (v, j) in enumerate(sorted(met)[:5], 1) if n >= 2}
    out = M.substitutes(df)
    got = [(r.id, r.substitute_id, r.saving, r["rank"]) for r in out.collect()]
    assert len(got) == len(want) > 200 and {*got} == want
    assert "windowspecdefinition(left_set" in out._jdf.queryExecution().analyzed().toString()
    assert not any("part.parquet" in f for f in matching_queries.er16_core_substitutes(spark, data).inputFiles())


def test_candidates_are_counted_as_pairs_are(spark, data):
    save = saver(spark)
    for f in (_catalog(spark), M.features(matching_queries.listings(spark, data)), _features(spark, 700, "AB1234", "Fine Paper Point")):
        f = save(f)
        index = save(M.blocking_index(f))
        want = {r.listing_id: [0, 0, 0] for r in f.select("listing_id").collect()}
        for r in M.candidate_pairs(index, rules=True).collect():
            for i in (r.left_id, r.right_id):
                want[i] = [n + k for n, k in zip(want[i], (1, r.by_code, r.by_words))]
        got = M.candidate_counts(f, index, save).collect()
        assert len(got) == len(want) and {r.listing_id: [r.n_links, r.n_code, r.n_words] for r in got} == want
        kinds = {}
        for r in index.where("key LIKE 'words:%'").groupBy("listing_id").agg(F.sort_array(F.collect_list("key")).alias("k")).collect():
            kinds.setdefault(tuple(r.k), []).append(r.listing_id)
        named = {i: min(ids) for ids in kinds.values() for i in ids}
        assert {r.listing_id: r.class_id for r in got} == {i: named.get(i, i) for i in want}


def test_candidate_queries_give_every_pair(spark, data):
    """Pairs made between kinds are those of the lists, each once, and the queries give them all."""
    save = saver(spark)
    for f in (_catalog(spark), _features(spark, 700, "AB1234", "Fine Paper Point"), M.features(matching_queries.listings(spark, data))):
        index = save(M.blocking_index(save(f)))
        want = {tuple(r) for r in M.candidate_pairs(index, rules=True).collect()}
        got = M.kind_pairs(index, save).select("left_id", "right_id", "by_code", "by_words").collect()
        assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want
    got = registry.queries()["er04_blocking"](spark, data).select("left_id", "right_id", "by_code", "by_words").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = registry.queries()["j12_candidate_pairs"](spark, data).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == {p[:2] for p in want}


def test_overlaps_are_counted_as_pairs_are(spark):
    words = {i: ["common", "often" if i % 2 else "else", "often" if i % 3 else "third", f"w{i % 40}", None][: 1 + i % 6] for i in range(700)}
    df = spark.createDataFrame(list(words.items()), "id long, words array<string>")
    sets = {i: frozenset(w for w in ws if w) for i, ws in words.items()}
    left = [i for i in words if i % 20 < 2]
    for least in (1, 2):
        met = {a: [n for b in words if (n := len(sets[a] & sets[b])) >= least] for a in left}
        least_of = {a: min(b for b in left if sets[b] == sets[a]) if len(sets[a]) >= least else a for a in left}
        want = {(a, least_of[a], len(n), sum(n)) for a, n in met.items()}
        got = search.overlap_counts(df.where("id % 20 < 2"), df, least, 7).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_functional_keys_link_all_pairs(spark, data):
    key = {p.p_partkey: (re.sub("[^A-Za-z0-9]", "", p.p_brand).lower(), p.p_name) for p in spark.read.parquet(f"{data}/part.parquet").collect()}
    got = registry.queries()["j11_functional_key_join"](spark, data).collect()
    want = {(a, b) for a in key for b in key if a < b and key[a] == key[b]}
    assert len(got) == len(want) > 0 and {(r.left_id, r.right_id) for r in got} == want


def test_every_product_has_its_siblings_in_order(spark, tmp_path):
    """Families of any size, sizes that are equal or missing, and products outside families."""
    draw = random.Random(5)
    parts = [(i, draw.choice(["red nut", "blue nut", f"own {i}"]), "B", draw.choice(["X", "Y"]), draw.choice([1, 2, 2, 3, None])) for i in range(120)] + [(200, "even nut", "B", "X", 4), (201, "even nut", "B", "X", 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    families = {}
    for i, name, _, kind, size in parts:
        families.setdefault((name, kind), []).append((size is None, size or 0, i, size))
    families = [sorted(f) for f in families.values() if len({size for *_, size in f} - {None}) >= 2]
    want = {(a[2], b[2], b[3], n) for f in families for a in f for n, b in enumerate((b for b in f if b is not a), 1)}
    got = registry.queries()["j19_family_siblings"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 1000 and {(r.canonical_id, r.sibling_id, r.variant_rank, r.position) for r in got} == want


def test_overlap_query_gives_its_pairs(spark, data):
    words = {p.p_partkey: {*f"{p.p_name} {p.p_type} {p.p_brand}".lower().split(" ")} for p in spark.read.parquet(f"{data}/part.parquet").collect()}
    want = {(a, b, n) for a in words if a % 50 == 0 for b in words if (n := len(words[a] & words[b])) >= 2}
    got = registry.queries()["j08_overlap_join"](spark, data).collect()
    assert len(got) == len(want) > 0 and {(r.left_id, r.right_id, r.shared) for r in got} == want


def test_vendors_of_one_name_are_looked_up_once(spark):
    names = spark.createDataFrame([(i, "ABC corp" if i % 2 else "bc") for i in range(300)], "id int, name string")
    suppliers = spark.createDataFrame([(i, "abc" if i % 2 else "Abc Corp") for i in range(10, 310)], "id int, name string")
    got = search.vendor_contains(names, suppliers, 4)
    assert {tuple(r) for r in got.collect()} == {(i, 10) for i in range(300)}
    # the found suppliers go back to the vendors by name
    assert re.search(r"Join Inner, \(vendor_id_n#\d+ = vendor_id_n#\d+\)", got._jdf.queryExecution().optimizedPlan().toString())


def _recorded(monkeypatch, saved: list):
    """Lets ``search`` note the columns and numbers of rows of what it writes."""
    plain = search.saver

    def saver_(spark):
        save = plain(spark)

        def noted(df):
            out = save(df)
            saved.append((set(out.columns), out.count()))
            return out

        return noted

    monkeypatch.setattr(search, "saver", saver_)


def test_cheaper_products_of_other_brands(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.choice(["x", "x", "x", "y", "z", None]), draw.choice([None, *range(100, 140)]), draw.choice([1, 2, 3])) for i in range(400)]
    want = set()
    for i, name, size, brand, best, n in rows:
        if n >= 2 and None not in (name, brand, best):
            near = sorted((c, j) for j, m, s, b, c, _ in rows if m == name and s == size and b not in (None, brand) and c is not None and c < best)
            want |= {(i, j, best - c) for c, j in near[:5]}
    offers = spark.createDataFrame(rows, "canonical_id long, name string, size int, brand string, best_cents long, n_suppliers int")
    got = M.cheaper_elsewhere(offers).collect()
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want


def test_copies_of_a_name_are_split_once(spark, monkeypatch):
    names = ["blue glove", "blue paper", "red glove kit", "kit", "paper points fine"]
    products = spark.createDataFrame([(i, names[i % 5], i % 3 > 0) for i in range(3000)], "id long, name string, priced boolean")
    queries = spark.createDataFrame([(7, "red gloves"), (8, "kit")], "id long, text string")
    saved = []
    _recorded(monkeypatch, saved)
    got = {(r.query_id, r.rank): r.product_id for r in search.fuzzy_search(queries, products, 0.12, 3).collect()}
    assert [got[7, k] for k in (1, 2, 3)] == [2, 7, 17] and [got[8, k] for k in (1, 2, 3)] == [8, 13, 23]
    assert saved and max(n for _, n in saved) < 200


def test_invoice_lines_of_one_kind_are_matched_once(spark, monkeypatch):
    lines = spark.createDataFrame([(f"l{i}", 1, [None, "K1X", "K77777X"][i % 3], ["blue bracket kit", None][i % 2]) for i in range(600)], "line_id string, supplier_id long, sku string, description string")
    listings = spark.createDataFrame([(5, 1, "K1X", "blue bracket kit"), (6, 2, "K77777X", "other")], "listing_id long, supplier_id long, sku string, name string")
    saved = []
    _recorded(monkeypatch, saved)
    got = {r.line_id: (r.listing_id, r.match_status, r.confidence) for r in search.match_invoice_lines(lines, listings).collect()}
    by_sku = [{0: (5, "needs_review", 70), 1: (None, "unmatched", 0)}, {0: (5, "exact", 97), 1: (5, "exact", 97)}, {0: (6, "exact", 85), 1: (6, "exact", 85)}]
    assert got == {f"l{i}": by_sku[i % 3][i % 2] for i in range(600)}
    assert max(n for c, n in saved if "words" in c) == 6


def test_supplier_pairs_are_not_shuffled(spark):
    offers = spark.createDataFrame([(p, s) for p in range(60) for s in range(p % 7)], "product_id long, supplier_id long")
    got = reports.supplier_pairs(offers, 3)
    assert {tuple(r) for r in got.collect()} == {(a, b, sum(p % 7 > b for p in range(60))) for b in range(6) for a in range(b)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(supplier_a" in plan and not re.search(r"hashpartitioning\(supplier_a#\d+L, supplier_b", plan)


def test_items_are_planned_as_their_offers_are(spark):
    """Lines that repeat, items without offers and offers without a price; each list's plan is that of all its offers."""
    draw = random.Random(6)
    lines = [(draw.randint(1, 60), draw.randint(1, 25), float(draw.randint(1, 4))) for _ in range(300)] + [(61, 99, 1.0), (62, 1, 2.0), (62, 99, 2.0), (63, 98, 1.0), (62, None, 1.0), (None, 3, 2.0)]
    policy = {s: (draw.choice([None, 20.0, 40.0]), draw.choice([None, 5.0, 9.95])) for s in range(12)}
    prices = [(n, s, draw.choice([None, 0.1, 1.0, 1.0, 1.0]) and round(draw.uniform(2, 12), 2), *policy[s]) for n in range(1, 26) for s in draw.sample(range(12), 6) for _ in range(2)] + [(98, 3, None, None, 5.0)]
    lines = spark.createDataFrame(lines, "list_id long, line_no long, qty double")
    prices = spark.createDataFrame(prices, "line_no long, supplier_id long, unit double, free_threshold double, flat double")
    whole = lines.groupBy("list_id", "line_no").agg(F.sum("qty").alias("qty"))
    offers = whole.join(prices.where("unit IS NOT NULL"), "line_no").select("list_id", "line_no", "supplier_id", F.round(F.col("unit") * F.col("qty"), 2).alias("cost"), "free_threshold", "flat")
    got, want = plan.optimise_items(lines, prices), {tuple(r) for r in plan.optimise(whole, offers).select(*plan.NAMES).collect()}
    rows = got.select(*plan.NAMES).collect()
    assert len(rows) == len(want) == whole.count() and {tuple(r) for r in rows} == want
    assert sum(r.supplier_id is None for r in rows) >= 3 and any(r.plan_total < r.cheapest_total for r in rows if r.plan_total)
    # offers make no rows before they are chosen from
    assert "Generate explode(offers" not in got._jdf.queryExecution().toString()


def test_clusters_meet_by_codes_only_while_some_do(spark):
    """Clusters and their bounds are not brought to pairs by codes when there are none."""
    rows = [(i, str(i), f"AB{i}00{i}Q", "Acme", f"Fine Paper Point {'blue' if i % 2 else 'red'}", "10/Box") for i in range(12)]
    f = M.features(spark.createDataFrame(rows, "listing_id long, supplier_id string, sku string, brand string, name string, pack_size string"))
    kept, save = [], saver(spark)

    def noted(df):
        kept.append(df.columns)
        return save(df)

    got = class_clusters.clusters_by_classes(save(f), noted).collect()
    assert len(got) == len(rows) and len({r.cluster for r in got}) < len(rows)
    assert not any("x_classes" in c for c in kept)
