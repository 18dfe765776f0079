"""Elements that lie in their own kind."""

import random
import re

from pyspark.sql import functions as F

from marlstone.operators import dialects


def first_element(html, tag, cls):
    """The inside of the first element of this tag and class, by a walk over the tags."""
    for begin in re.finditer(rf'<{tag}\b[^>]*class="{cls}"[^>]*>', html):
        depth = 1
        for m in re.finditer(rf"<(/?){tag}\b[^>]*>", html[begin.end() :]):
            depth += -1 if m[1] else 1
            if not depth:
                return html[begin.end() : begin.end() + m.start()]
        return None
    return None


def page(rng, depth=0):
    if depth > 5 or rng.random() < 0.2:
        return rng.choice(["text", "a &lt; b", "<img src='x'>", "<br>", ""])
    tag = rng.choice(["div", "span", "td", "p", "section"])
    cls = rng.choice(['', ' class="x"', ' class="y"', ' id="n"'])
    return f"<{tag}{cls}>" + "".join(page(rng, depth + 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"


def test_inner_against_a_walk(spark):
    rng = random.Random(3)
    pages = ["".join(page(rng) for _ in range(5)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").withColumn("html", dialects.numbered(F.col("html")))
    plain = lambda c: F.regexp_replace(c, r"~\d+", "")
    found = df.select("i", *[plain(dialects.inner(F.col("html"), t, c)).alias(f"{t}_{c}") for t in ("div", "span", "td", "section") for c in ("x", "y")]).collect()
    for r in found:
        for name, got in r.asDict().items():
            if name != "i":
                assert got == first_element(pages[r.i], *name.split("_")), (name, pages[r.i])
    assert sum(r.div_x is not None for r in found) > 20


def test_numbers(spark):
    one = lambda h: spark.createDataFrame([(h,)], "h string").select(dialects.numbered(F.col("h")).alias("h")).first().h
    assert one("<div><DIV a></DIV><p></p></div></div><div>") == "<div~1><div~2 a></div~2><p></p></div~1></div~0><div~1>"
    assert one("<!-- <div> --><td><script>'<td>'</script></td>") == "<td~1></td~1>"
    assert one("plain") == "plain" and one("") == ""
    # Elements whose names begin alike are told apart.
    assert one("<sectional><thead><th></th></thead>") == "<sectional><thead><th~1></th~1></thead>"


def test_a_skill_in_a_wrapper(spark):
    """A name that sits in an inner element does not end its skill."""
    html = '<h1>Mon V</h1><div class="skillInformation"><div class="skill"><div><span class="skillName">Slam</span></div><span class="skillDamage">30</span><div><p class="skillEffect">Hits.</p></div></div></div>'
    r = dialects.asian(spark.createDataFrame([(html, "https://x/detail/00123/")], "html string, url string"), "hk").first()
    assert [(a.name, a.damage, a.effect) for a in r.attacks] == [("Slam", "30", "Hits.")]
