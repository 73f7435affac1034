from lodestone.operators import elements


def scan(html):
    return elements.Scanner().elements(html)


def test_blocks_links_images_and_entities():
    found = scan("""<!DOCTYPE html><head><title>A &amp; B</title><style>p{}</style><script>if (a<b) "</p>"</script></head>
      <body><p>One &eacute;&#233;&#x1F600;&notanentity; <b>bold</b>
      text<p>Two<br>three <a href='/x?a=1&amp;b=2'>a <i>link</i></a>, <img src=i.png alt="an  image"><!-- no <p> --> end""")
    assert found == [("text", "A & B", None), ("text", "One éé😀¬anentity; bold text", None), ("text", "Two", None), ("link", "a link", "/x?a=1&b=2"), ("image", "an image", "i.png"), ("text", "three a link, end", None)]


def test_tables_with_spans():
    found = scan("<p>before</p><table><tr><th>a<th colspan=2>b|c</tr><tr><td rowspan=2>d<td>e<td>f<tr><td>g</table>after")
    assert found == [("text", "before", None), ("table", "| a | b\\|c | b\\|c |\n| --- | --- | --- |\n| d | e | f |\n| d | g |  |", None), ("text", "after", None)]


def test_broken_markup():
    assert scan("</td></table><td>x</b>") == [("text", "x", None)]
    assert scan("<table><td>one<td>two") == [("table", "| one | two |\n| --- | --- |", None)]
    assert scan("<table><tr></tr></table>") == [] == scan("") == scan("<")[:0]
    assert scan("<a href=x>never closed <a href=y>next") == [("link", "never closed", "x"), ("link", "next", "y"), ("text", "never closed next", None)]
    assert scan("<p>cut in a tag <a href='") == [("text", "cut in a tag", None)] or scan("<p>cut in a tag <a href='")[0][1].startswith("cut in a tag")
    assert scan("<script>never closed <p>x</p>") == []
    assert scan("<table><tr><td colspan='9x' rowspan=0>a</table>") == [("table", "| a |\n| --- |", None)]


def test_tables_inside_cells():
    found = scan("<table><tr><td>out <table><tr><td>in</table> more<td>x</table>")
    assert found == [("table", "| in |\n| --- |", None), ("table", "| out more | x |\n| --- | --- |", None)]


def test_grid_ends_with_the_table():
    assert elements.grid([[("a", 65534, 1), ("b", 1, 2)], [("c", 1, 1)]]) == [["a", "b", "b"], ["a", "c", ""]]
    assert elements.markdown([]) == ""


def test_elements_of_a_table(spark):
    rows = [(1, "<p>x</p><p>y"), (2, None), (3, ""), (4, "<img>"), (5, "<p>" + "word " * 50_000)]
    out = elements.elements(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert [(r["page_id"], r["element_no"], r["kind"], r["content"][:4], r["target"]) for r in out] == [(1, 0, "text", "x", None), (1, 1, "text", "y", None), (4, 0, "image", "", None), (5, 0, "text", "word", None)]
