"""Rules of postings, logs, as-of rows and publishing, branch by branch."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import evidence, joins
from gristmill.sources import logs, publish


def of(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_experience(spark):
    cases = {
        "3-5 years": 3, "3 – 5 yrs": 3, "3 to 5 years": 3, "2+ years": 2, "30 years": 30, "50 years": 50, "51 years": None, "60-5 years": 5, "18 years old": None, "18 years of age, 4 years of Go": 4,
        "No experience is required": 0, "no prior experience needed, 5 years": 0, "no previous  experience\nnecessary for this position": 0, "no experience required with X": None, "no prior experience is required in Go but 3 years of C": 3,
        "no experience with Go is required, 6 years": 6, "about ten years": None, "": None, "Optional:\n1 year of Go\nOffer:\n4 years here": 4,
    }
    assert of(spark, [*cases, None], tx.experience_years) == [*cases.values(), None]


def test_recruiter(spark):
    yes = ["On behalf of our client", "on behalf of one of our esteemed client", "Our client is seeking", "our valued client is a bank", "our client, a bank,", "About our client", "recruiting two engineers on behalf of X", "a mid-size client of ours", "Join our client’s team", "our customer is hiring for", "our <b>client</b> is *looking*"]
    no = ["we listen to our client", "depending on our client's needs", "our clients love us", "confidential client information", "for a client base", "staffing", "", None]
    assert of(spark, yes, tx.via_recruiter) == [True] * len(yes)
    assert of(spark, no, tx.via_recruiter) == [None] * len(no)


def test_education(spark):
    cases = {"Ph.D. in X": "phd", "doctoral work": "phd", "Master’s": "master", "scrum master": None, "MS Office": None, "graduate degree": "master", "B.Sc": "bachelor", "undergraduate degree": "bachelor", "without a degree": "none", "no diploma": "none", "Bachelor's; no degree required": "bachelor", "Preferred:\nPhD\nNeeds:\nBSc": "bachelor", "": None}
    assert of(spark, [*cases, None], tx.education_level) == [*cases.values(), None]
    own = {"MS": "master", "B.S.": "bachelor", "Master of Fine Arts": "master", "Bachelor": "bachelor", "Diploma": None, "no degree": None, "PhD": "phd"}
    assert of(spark, list(own), lambda c: tx.education_level(c, own=True)) == list(own.values())


def test_liveness(spark):
    long = "visible words " * 40
    rows = [
        (404, "u", long, ("expired", "http_gone")), (410, None, None, ("expired", "http_gone")), (503, "u", long, ("uncertain", None)), (302, "u", long, ("uncertain", None)), (None, "u", long, ("uncertain", None)), (0, "u", "", ("uncertain", None)),
        (200, "http://x/?a=1&ERROR=true", long, ("expired", "expired_url")), (200, "u", long + "Applications have closed", ("expired", "expired_body")), (200, "u", long + "ВАКАНСИЯ В АРХИВЕ", ("expired", "expired_body")), (200, "u", long + "this job listing is closed. 3 jobs found", ("expired", "expired_body")),
        (200, "u", long + "27 Jobs found", ("expired", "listing_page")), (200, "http://x/jobs", long, ("live", None)), (200, "u", "<head>" + "<style>a{b:c}</style>" * 50 + "</head><p>few</p>", ("expired", "insufficient_content")), (200, "u", None, ("expired", "insufficient_content")), (204, None, long, ("live", None)),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, status int, url string, body string")
    got = [tuple(r["l"]) for r in df.select("i", evidence.liveness(F.col("status"), F.col("url"), F.col("body")).alias("l")).orderBy("i").collect()]
    assert got == [r[3] for r in rows]


def test_views(spark):
    cases = {"/jobs/a-1": ("page", "a-1"), "/jobs/a-1?x=/y": ("page", "a-1"), "/jobs/a/__data.json": ("page", "a"), "/jobs/a/__data.json?x": ("page", "a"), "/api/v1/jobs/a": ("api", "a"), "/api/jobs/a": None, "/jobs/": None, "/jobs/a/": None, "/jobs/a/similar": None, "/jobs": None, "/x/jobs/a": None}
    got = of(spark, list(cases), lambda p: logs.viewed(F.lit("GET"), p, F.lit(200), F.lit(None).cast("string")))
    assert [tuple(v) if v else None for v in got] == list(cases.values())
    agents = {"Googlebot/2.1": True, "x bingbot; y": True, "somebot": True, "Bot-Net": True, "CUBOT_X30": False, "Mozilla/5.0 (CUBOT)": True, "CUBOT X30": True, "curl/8": False, "HeadlessChrome": True, "my crawler": True, "robotics": False, "": False}
    assert of(spark, [*agents, None], logs.is_bot) == [*agents.values(), False]


def test_log_lines(spark):
    good = '9.9.9.9 - - [01/Jan/2024:10:00:00 +0000] "GET /jobs/a HTTP/1.1" 200 5 "-" "UA" "prefetch" rest'
    bad = ['9.9.9.9 - - [01/Jan/2024:10:00:00 +0000] "GET /jobs/a" 200 5 "-" "UA"', "", "x" * 1000, '9.9.9.9 - - [x] "-" 400 0 "-" "-"']
    rows = logs.parse_access(spark.createDataFrame([(x,) for x in [good, good.replace('"UA"', '"-"').replace(' "prefetch" rest', ""), *bad]], "value string")).collect()
    assert [(r["ip"], r["method"], r["path"], r["status"], r["agent"], r["purpose"]) for r in rows] == [("9.9.9.9", "GET", "/jobs/a", 200, "UA", "prefetch"), ("9.9.9.9", "GET", "/jobs/a", 200, None, None)]


def test_asof_takes_whole_rows(spark):
    left = spark.createDataFrame([(5,)], "x long")
    right = spark.createDataFrame([(3, "b", 1), (3, "a", 9)], "m long, v string, w int")
    for by in (None, ["g"]):
        a, b = (df.withColumn("g", F.lit(1)) if by else df for df in (left, right))
        assert [(r["m"], r["v"], r["w"]) for r in joins.asof(a, b, "x", "m", ["v", "w"], by=by).collect()] == [(3, "b", 1)]


def test_readers_always_find_a_version(spark, tmp_path):
    path, seen, stop = f"file://{tmp_path}/t", [], threading.Event()
    publish.publish(spark.range(1), path)

    def read():
        while not stop.is_set():
            try:
                seen.append(json.loads(max((tmp_path / "t").glob("current-*.json")).read_text())["current"])
            except FileNotFoundError:
                continue  # removed since it was listed: a newer one is there
            except ValueError as e:
                seen.append(repr(e))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 6):
        publish.publish(spark.range(n), path)
    stop.set()
    reader.join()
    assert all(v.startswith("v-") for v in seen) and publish.current(spark, path).count() == 5


@pytest.mark.parametrize("slices", [1, 3, None])
def test_asof_ranges(spark, slices):
    left = spark.range(40).withColumnRenamed("id", "x")
    right = spark.createDataFrame([(i * i, f"v{i}") for i in range(7)], "m long, v string")
    got = [r["m"] for r in joins.asof(left, right, "x", "m", ["v"], slices=slices).orderBy("x").collect()]
    assert got == [max(i * i for i in range(7) if i * i <= x) for x in range(40)]
