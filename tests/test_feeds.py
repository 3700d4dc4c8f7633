"""Feed readers on small files."""

from lurewatch.sources import feeds


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lists(spark, tmp_path):
    p = put(tmp_path / "pt.csv", "phish_id,url,phish_detail_url,submission_time,verified,verification_time,online,target\n1,http://sbi-x.xyz:80/a,u,t,yes,t,yes,Other\n2,http://b.com,u,t,yes,t,no,SBI\n3,http://c.com,u,t,yes,t,yes,Other\n")
    assert rows(feeds.phishtank(spark, p)) == [("sbi-x.xyz", "Phishing", "phishtank")]
    p = put(tmp_path / "op.txt", "# c\n\nhttp://A.com/x\n  b.org  \n")
    assert [r[0] for r in rows(feeds.lines(spark, p, "openphish"))] == ["a.com", "b.org"]
    p = put(tmp_path / "uh.csv", '# head\n"1","d","http://x.com/login","online","l","malware","a,b","s","r"\n"2","d","http://y.com/","offline","l","m","t","s","r"\n"3","d","http://z.com/","unknown","l","m","t","s","r"\n')
    assert [r[0] for r in rows(feeds.urlhaus(spark, p))] == ["x.com", "z.com"]
    assert [r[0] for r in rows(feeds.urlhaus(spark, p, phishing_only=True))] == ["x.com"]
    p = put(tmp_path / "tr.csv", "1,a.com\n1000,b.com\n101000,c.com\n101001,d.com\n5,b.com\n")
    assert [r[0] for r in rows(feeds.ranked(spark, p))] == ["b.com", "c.com"]
    assert dict(rows(feeds.rank_lookup(spark, p)))["b.com"] == 5  # the last one of the file


def test_flexible_and_workbook(spark, tmp_path):
    a = put(tmp_path / "a.csv", "Some Domain,Class Label\nx.com,Phishing\n")
    b = put(tmp_path / "b.csv", "other,thing\n1,2\n")
    assert rows(feeds.flexible(spark, {"a": a, "b": b})) == [("x.com", "Phishing", "mock_a")]
    (tmp_path / "ev").mkdir()
    put(tmp_path / "ev" / "1.pdf", "x")
    df = spark.createDataFrame([("1.pdf",), ("2.pdf",), (None,)], "evidence_filename string")
    assert sorted(r.evidence_exists for r in feeds.with_evidence(df, str(tmp_path / "ev")).collect()) == [False, False, True]


def test_logs(spark):
    e = spark.createDataFrame([("sbi", 1, "*.a.com\nb.com"), ("sbi", 2, "c.com"), ("pnb", 1, "")], "keyword string, entry int, name_value string")
    assert rows(feeds.certificate_entries(e, 1)) == [("sbi", "a.com"), ("sbi", "b.com")]
    m = spark.createDataFrame([("see https://www.A.com/x and", ["http://b.com", "mailto:c"]), (None, None)], "text string, hrefs array<string>")
    assert rows(feeds.channel_links(m)) == [("a.com",), ("b.com",)]
    m = spark.createDataFrame([("https://t.me/x https://host.in:8080/y", None)], "text string, hrefs array<string>")
    assert rows(feeds.channel_links(m)) == [("host.in:8080",)]
    r = spark.createDataFrame([(1, "Bank", " A.in "), (2, None, "b.in"), (3, "Rail", None)], "row int, organisation string, domain string")
    assert rows(feeds.brand_reference(r)) == [("a.in", "Bank"), ("b.in", "Bank")]
