import duckdb

from isocline.llm import licences, url_filter

URLS = [
    "http://Example.COM/en/7x?a#b", "https://www.example.com/en/8", "ftp://a.b.com/en/", "http://notexample.com/en/7", "x://example.net/de/85", "http://example.net/de/9",
    "http://m.org/es/#q", "http://org/es/", "http://com", "http://spam-farm.example.com", "https://blog.cheap-pills.example.net/x?y", "http://xcheap-pills.example.net/", "no scheme", "", None,
    "http://", "http:///en/", "http://É.com/en/1", "a://b://c.com/en/", "http://example.com\\en/7", "http://example.com/EN/7", "http://example.com/en/7\nrest",
]


def test_urls_equal_sql(spark):
    rows = [(i, u, "html") for i, u in enumerate(URLS)] + [(3, URLS[3], "again"), (None, URLS[0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(df, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    db = duckdb.connect()
    db.register("pages", df.toPandas())
    want = sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE})").fetchall(), key=str)
    assert got == [(int(p) if p is not None and p == p else None, *rest) for p, *rest in want]
    assert url_filter.filter_urls(df.where("false"), url_filter.rule_table(spark)).collect() == []
    none = url_filter.filter_urls(df, url_filter.rule_table(spark).where("false")).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}


CANONICAL = [
    "http://casino-win.example.com:80/", "http://u@casino-win.example.com/", "http://casino-win.example.com./", "http://u:p@m.casino-win.example.com.:8080", "http://Casino%2DWin.example%2Ecom/x",
    "http://casino-win.example.com@other.org/", "http://example.com:80/en/7", "http://m.org:80/es/", "http://100%.example.com/", "http://a+b%20c.example.com/", "http://casino-win.example.com.evil.org/",
]


def test_listed_sites_by_canonical_host(spark):
    df = spark.createDataFrame(list(enumerate(CANONICAL)), "page_id long, url string")
    rows = url_filter.filter_urls(df, url_filter.rule_table(spark)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in rows) == [(i, None, "block" if i < 5 else "allow") for i in range(len(CANONICAL))]
    assert {r.page_id: r.host for r in rows}[3] == "u:p@m.casino-win.example.com.:8080"
    db = duckdb.connect()
    db.register("pages", df.toPandas())
    want = sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE})").fetchall())
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == want


def test_sites_of_a_table(spark):
    sites = spark.createDataFrame([("Bad.Example.ORG.",), ("bad.example.org",), ("",), (None,), ("worse.com",)], "site string")
    urls = ["http://bad.example.org/a", "http://x.worse.com", "http://worse.com.au/", "http://example.org/", "http://" + "a." * 5000 + "worse.com/" + "p" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(df, url_filter.rule_table(spark, sites=sites)).collect())
    assert got == [(0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block")]


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 3000 // url_filter.KEYS
    table = url_filter.bloom_blocks(keys, blocks)

    def passing(names):
        at = names.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(table, "block")
        test = F.lit(True)
        for w in range(url_filter.WORDS):
            mask = url_filter._mask(F.col("key"), w)
            test = test & (F.col(f"w{w}").bitwiseAND(mask) == mask)
        return at.where(test).count()

    assert passing(keys) == 3000
    assert passing(spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))) < 200


def test_licences_by_canonical_text(spark):
    mit = licences.KNOWN[0][1]
    changed = "Copyright (c) 2001 Somebody\n\n" + mit.upper().replace(" ", "  \n").replace("SUBLICENSE", "sub-licence").replace(",", "")
    rows = [(1, changed), (2, mit + " extra"), (3, "Hello\nLicenced under the Apache Licence, version 2.0\nRELEASED under the MIT License!"), (4, None), (5, " ... "), (6, ""), (1, changed)]
    known = licences.known_digests(spark)
    out = sorted((r.doc_id, r.licence or "", tuple(r.line_licences)) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect())
    assert out == [(1, "MIT", ()), (1, "MIT", ()), (2, "", ()), (3, "", ("Apache-2.0", "MIT")), (4, "", ()), (5, "", ()), (6, "", ())]
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string"), known).collect() == []


def scanned(spark, rows, known):
    """The scan's rows, which must be those of the query's SQL where the known texts are the query's."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.digest, r.licence, r.line_licences) for r in licences.scan_licences(df, known).collect())
    db = duckdb.connect()
    db.register("documents", df.toPandas())
    return out, sorted(db.execute(f"SELECT doc_id, digest, licence, line_licences FROM ({licences.ORACLE})").fetchall())


def test_spellings_titles_and_names_equal_sql(spark):
    isc = next(t for n, t in licences.KNOWN if n == "ISC" and "\n" in t)
    zlib = next(t for n, t in licences.KNOWN if n == "Zlib")
    long = "ordinary words of a text\n" * 50_000 + "Licenced under CC-BY 4.0\n" + "word " * 200_000
    texts = [
        f"ISC License\n\nCopyright (c) 2004-2010 by A Consortium, Inc. (\"ISC\")\n\n{isc}", f"Copyright The Example Authors\n{isc.lower()}", f"# Copyright Acme, Inc.\n# and more\n{isc}",
        "\n".join(f" * {x}" for x in zlib.split("\n")), "THE ZLIB/LIBPNG LICENCE\r\n" + zlib.replace("\n", "\r\n"), "The MIT License (MIT)\nCopyright Someone and the Others\n" + licences.KNOWN[0][1],
        "This work is licenced under the GNU General Public Licence version 3", "x\nThis work is licensed under the gpl, v2!!\ny", "This work is licensed under the GNU General\nPublic License, version 3.",
        "copyright law is a field of its own\nLicensed under CC BY-NC 4.0", "Copyright " + "A" * 5000 + "!", "COPYRIGHT HOLDERS BE LIABLE", long, "", None, "\n\n", "İ é ß",
    ]
    got, want = scanned(spark, list(enumerate(texts)) + [(0, texts[0]), (0, texts[7])], licences.known_digests(spark))
    assert got == want
    found = {i: (name, lines) for i, _, name, lines in got if i}
    assert [found[i][0] for i in range(1, 9)] == ["ISC", None, "Zlib", "Zlib", "MIT", "GPL-3.0", None, "GPL-3.0"]
    assert found[6][1] == ["GPL-3.0"] and found[7][1] == ["GPL-2.0"] and found[9][1] == ["CC-BY-NC-4.0"] and found[12][1] == ["CC-BY-4.0"]
    assert sorted(str((n, x)) for i, _, n, x in got if i == 0) == sorted(map(str, [("ISC", []), ("ISC", []), (None, ["GPL-2.0"])]))


def test_any_known_text_matches_whatever_its_first_word(spark):
    """Texts that begin with a spelling that the canonical form changes."""
    known = licences.known_digests(spark, [("G", "GNU General Public License version 3"), ("N", "Non-commercial use only"), ("S", "sub-licensing is allowed")], ())
    rows = [(1, "a\nGNU General Public License, version 3\n"), (2, "Noncommercial use only."), (3, "x\n(non commercial use only)"), (4, "Sublicencing is allowed")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.licence, r.line_licences) for r in licences.scan_licences(df, known).collect()}
    assert out == {1: (None, ["G"]), 2: ("N", ["N"]), 3: (None, ["N"]), 4: ("S", ["S"])}
    many = spark.range(200_000).selectExpr("cast(id as string) as licence", "sha2(concat('k', id), 256) as digest")
    assert {r.doc_id: r.licence for r in licences.scan_licences(df.unionByName(spark.createDataFrame([(9, "K77")], df.schema)), many).collect()}[9] == "77"


def test_clashing_columns_and_no_worker_of_python(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License", "a", "b", 3)], "doc_id long, text string, digest string, licence string, at int")
    out = licences.scan_licences(df, licences.known_digests(spark))
    assert [tuple(r)[2:] for r in out.collect()] == [("MIT", ["MIT"])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digests_of_long_licences(spark):
    import os

    from pyspark.sql import functions as F

    folder, files = "/usr/share/common-licenses", {"GPL-3.0": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}
    if not os.path.isdir(folder):
        return
    rows = [(k, open(f"{folder}/{f}", encoding="utf-8").read().replace("\n", "\n  ")) for k, f in files.items()]
    got = spark.createDataFrame(rows, "licence string, text string").select("licence", F.sha2(licences.canonical(F.col("text")), 256).alias("d")).collect()
    assert {(r.licence, r.d) for r in got} <= set(licences.DIGESTS)
