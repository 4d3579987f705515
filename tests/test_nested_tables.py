import random

from bidlens.sources import pages as pg

HTML = """<p>before <td>stray</td></table>
<TABLE><tr><th colspan=2>Firm &amp; Name<th rowspan="2">Country
<tr><td>A &lt;b&gt; &eacute;&#233;&#xE9; &nosuch; &amp;lt;</td><td><table><tr><td>in<b>ner</b></td></tr>
<tr><td>deep <table><tr><td>x</table></td></tr></table>&nbsp;outer
</tr><tr></tr><tr><td rowspan=9>Z<td>1<!-- <td>no</td> --><script>"<td>no"</script><td>2</table>
<table><td>no row</td></table>"""


def test_nested_tables_spans_and_unclosed_cells(spark):
    pages = spark.createDataFrame([(1, "u", HTML), (2, "u", "<p>none</p>"), (3, "u", None), (4, "u", "<table></table>")],
                                  "page_id long, url string, html string")
    got = {(r.page_id, r.table_no, r.row_no, r.col_no): r.text for r in pg.table_grid(pages).collect()}
    assert got == {
        (1, 0, 0, 0): "Firm & Name", (1, 0, 0, 1): "Firm & Name", (1, 0, 0, 2): "Country", (1, 0, 1, 2): "Country",
        (1, 0, 1, 0): "A <b> \u00e9\u00e9\u00e9 &nosuch; &lt;", (1, 0, 1, 1): "outer",
        (1, 0, 3, 0): "Z", (1, 0, 3, 1): "1", (1, 0, 3, 2): "2",
        (1, 1, 0, 0): "inner", (1, 1, 1, 0): "deep", (1, 2, 0, 0): "x", (1, 3, 0, 0): "no row"}
    first = pg.html_tables(pages, headers=("Firm",)).select("table_no").distinct().collect()
    assert [r.table_no for r in first] == [0]


def make(rng, depth, want, at):
    """A random table's HTML; its cells' own texts go to ``want``."""
    no = at[0]
    at[0] += 1
    out = ["<table class='t'>"]
    for r in range(rng.randrange(4)):
        out.append("<tr>")
        for c in range(rng.randrange(4)):
            text = f"t{no}r{r}c{c}"
            want[no, r, c] = text
            inner = make(rng, depth - 1, want, at) if depth and rng.random() < 0.4 else ""
            out.append(f"<td>{text}{inner}" + ("</td>" if rng.random() < 0.7 else ""))
        out.append("</tr>" if rng.random() < 0.7 else "")
    return "".join(out) + "</table>"


def test_random_nesting(spark):
    rng, pages, want = random.Random(6), [], {}
    for p in range(40):
        own, at = {}, [0]
        pages.append((p, "u", "x".join(make(rng, 3, own, at) for _ in range(3))))
        want.update({(p, *k): v for k, v in own.items()})
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.table_no, r.row_no, r.cell_no): r.text for r in pg.table_cells(df).collect()}
    assert got == want
