import datetime as dt
import random

from standtally.llm import url_lists

ENTRIES = "list string, scope string, pattern string, dated date, action string"
CAPTURES = "page_id bigint, url string, fetched_on date, n_block string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def plain(captures, entries):
    """Every capture against every pattern's state on the day, one by one."""
    out = []
    for page_id, url, on, _ in captures:
        block = allow = 0
        if url and on and "://" in url:
            rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
            host, *path = rest.split("/")
            host = host.rsplit("@", 1)[-1].split(":")[0].lower()
            parts = [p for p in path if p]
            covers = {("host", host)}
            labels = host.split(".")
            covers |= {("domain", ".".join(labels[i:])) for i in range(len(labels))}
            covers |= {("prefix", "/".join([host, *parts[: i + 1]])) for i in range(len(parts))}
            for name, scope, pattern in {e[:3] for e in entries if None not in e}:
                if (scope, pattern) not in covers:
                    continue
                past = [e for e in entries if e[:3] == (name, scope, pattern) and None not in e and e[3] <= on]
                if past:
                    last = max(e[3] for e in past)
                    if not any(e[4] == "remove" for e in past if e[3] == last):
                        block, allow = block + (name != "allow"), allow + (name == "allow")
        out.append((page_id, url, on, block, allow, block > 0 and allow == 0))
    return sorted(out, key=repr)


def run(spark, captures, entries):
    got = url_lists.filter_captures(
        spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    )
    return sorted(
        ((r.page_id, r.url, r.fetched_on, r.n_block, r.n_allow, r.blocked) for r in got.collect()), key=repr
    )


def test_against_plain_version(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.test.org", "test.org"]
    paths = ["", "/", "/p", "/p/q", "/r?x=1", "/p/q/s#t"]
    captures = [
        (i, f"https://{rng.choice(hosts)}{rng.choice(paths)}", day(rng.randrange(40)), None) for i in range(300)
    ]
    captures += [(None, None, day(1), "x"), (1, "nonsense", day(1), None), (2, "http://A.Example.com:80/p", None, None),
                 (3, "http://u@A.EXAMPLE.com:80/p", day(20), None)] + captures[:5]
    scopes = [("domain", "example.com"), ("domain", "com"), ("host", "a.example.com"), ("host", "test.org"),
              ("prefix", "a.example.com/p"), ("prefix", "x.test.org/p/q"), ("domain", "test.org")]
    entries = [
        (rng.choice(["block", "other", "allow"]), *rng.choice(scopes), day(rng.randrange(40)), rng.choice(["add", "remove"]))
        for _ in range(60)
    ]
    entries += entries[:4] + [(None, "host", "test.org", day(1), "add"), ("block", "host", None, day(1), "add")]
    assert run(spark, captures, entries) == plain(captures, entries)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    capture = (1, "http://a.b/c", day(3), None)
    assert run(spark, [capture], []) == [(1, "http://a.b/c", day(3), 0, 0, False)]
    assert run(spark, [], [("block", "host", "a.b", day(1), "add")]) == []
