import pytest

from tessella.operators import dom
from tessella.operators.dom import NUMBERS, PageTokens, measure, parse, parse_closed, parsed_tokens, structure_ids, visible_strings
from tessella.operators.token_tree import TREE_NUMBERS


def rows(html):
    return [dict(zip(("position", "text", "tag", "classes", *NUMBERS), r, strict=True)) for r in PageTokens(html).rows()]


def texts(html):
    return [r["text"] for r in rows(html)]


def test_string_kinds_are_tokens():
    html = "<!DOCTYPE html><html><!-- note --><script>var t='</p>';</script><style>p{}</style><template>tpl</template>x</html>"
    assert texts(html) == ["html", "note", "var t='</p>';", "p{}", "tpl", "x"]
    assert rows(html)[0]["tag"] == "[document]"


def test_visible_text_leaves_out_special_strings():
    nodes = parse("<div>a<!-- c --><script>s</script><p> b <b>c</b></p></div>")
    assert visible_strings(nodes, nodes[1]) == ["a", "b", "c"]
    script = next(x for x in nodes if x.name == "script")
    assert visible_strings(nodes, script) == ["s"]


def test_void_elements_and_stray_end_tags():
    nodes = parse("<p>a<br>b</i></p><img src=x>c")
    assert [x.name for x in nodes if x.name] == ["[document]", "p", "br", "img"]
    assert texts("<p>a<br>b</i></p>c") == ["a", "b", "c"]


def test_unclosed_paragraphs_nest():
    nodes = parse("<p>a<p>b<p>c")
    measure(nodes)
    assert [x.stats.depth for x in nodes if x.name == "p"] == [1, 2, 3]


def test_end_tag_closes_up_to_its_element():
    nodes = parse("<div><b><i>x</div>y")
    assert next(x for x in nodes if x.text == "y").parent.name == "[document]"


def test_white_space_strings():
    nodes = parse("<p> \n </p><p>  </p><pre>  </pre>")
    assert [x.text for x in nodes if x.name is None] == ["\n", " ", "  "]


def test_length_limit_and_strip():
    assert texts(f"<p>{'a' * 500}</p><p>{'b' * 501}</p><p>  c  </p>") == ["a" * 500, "c"]


def test_equal_markup_has_one_structure():
    nodes = parse('<ul><li class="x">a</li><li class="x">a</li><li>a</li></ul><li class="x">a</li>')
    ids = structure_ids(nodes)
    items = [ids[x.index] for x in nodes if x.name == "li"]
    assert items[0] == items[1] == items[3] != items[2]


def test_first_equal_sibling_gives_the_index():
    found = rows("<ul><li>a</li><li>b</li><li>a</li></ul>")
    assert [r["sibling_index"] for r in found] == [0, 1, 0]


def test_positions_of_like_markup_join_the_block():
    found = rows("<div><p>x</p><p>y</p></div><section><p>x</p></section>")
    assert found[0]["block_size"] == 3  # x, y, and the x elsewhere
    assert found[0]["block_gap"] == 0.5 and found[1]["block_gap"] == 1.0


def test_styles_ids_and_classes():
    html = '<p id="abc" class="card-title big" style="font-size:12px; display:NONE; margin-top: 1.5em">x</p><p style="font-size:1.2.3">y</p>'
    first, second = rows(html)
    assert (first["font_size"], first["margin_top"], first["display_code"], first["style_properties"]) == (12.0, 1.5, 3.0, 3)
    assert (first["title_class"], first["n_classes"], first["id_chars"], first["class_chars"]) == (1.0, 2, 3, 6.5)
    assert second["font_size"] is None


def test_links_and_buttons_below():
    found = rows('<div>t<a href="/a/b">x</a><button>y</button><i role="button">z</i></div>')
    assert (found[0]["links"], found[0]["buttons"], found[1]["href_depth"], found[1]["is_link"]) == (1, 2, 2, 1.0)


def test_comment_below_html_has_no_own_position():
    found = rows("<html><!-- c --><body><p>x</p></body></html>")
    assert found[0]["text"] == "c"


@pytest.mark.parametrize("html", ["", "   ", "<p></p>", "<", "</p>", "<!", "&amp;"])
def test_odd_pages(html):
    assert len(rows(html)) <= 1


def test_deep_nesting():
    found = rows("<div>" * 3000 + "x")
    assert found[0]["depth"] == 3000


def test_many_paths_and_long_pages():
    deep = "<div>a b" * 1500
    assert len(PageTokens(deep, (*NUMBERS, *TREE_NUMBERS)).rows()) == 1500
    wide = "<ul>" + "<li>x <b>y</b></li>" * 5000 + "</ul>"
    found = PageTokens(wide, (*NUMBERS, *TREE_NUMBERS)).rows()
    assert len(found) == 10_000


def test_a_page_that_fails_gives_one_row(spark, monkeypatch):
    import pyarrow as pa

    def broken(html):
        if "bad" in html:
            raise ValueError("bad page")
        return parse(html)

    monkeypatch.setattr(dom, "parse", broken)
    batch = spark.createDataFrame([(1, "bad"), (2, "<p>fine</p>")], "page_id long, html string").toArrow().to_batches()
    for run in (dom._rows(pa.int64(), ()), dom._rows(pa.int64(), NUMBERS), dom._node_rows):
        found = [r for out in run(batch) for r in out.to_pylist()]
        assert [r["error"] for r in found if r["page_id"] == 1] == ["ValueError: bad page"]
        assert [r["text"] for r in found if r["page_id"] == 2][-1] == "fine"


def test_only_the_numbers_asked_for(spark):
    pages = spark.createDataFrame([("p", "<p>x</p>")], "page_id string, html string")
    assert parsed_tokens(pages, numbers=()).columns == ["page_id", "position", "text", "tag", "classes", "error"]
    row = parsed_tokens(pages, numbers=("t_depth", "depth")).first()
    assert (row.page_id, row.t_depth, row.depth) == ("p", 1.0, 1.0)
    with pytest.raises(ValueError):
        parsed_tokens(pages, numbers=("none",))


def test_large_pages_take_memory_in_proportion():
    import tracemalloc

    import pyarrow as pa

    peaks = []
    for n in (500, 4000):  # half of all paragraphs share the markup of each bold text
        items = "".join(f'<p><a href="/{k}">name {k}</a><b>{"xy"[k % 2]}</b> z.</p>' for k in range(n))
        pages = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([f"<div>{items}</div>"])], ["page_id", "html"])
        tracemalloc.start()
        sizes = [x.num_rows for x in dom._rows(pa.int64(), NUMBERS)([pages])]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(sizes) == 3 * n and max(sizes) <= 2 * dom.BATCH_ROWS
    assert peaks[1] < 10 * peaks[0]


def test_a_page_that_fails_late_gives_one_row(monkeypatch):
    import pyarrow as pa

    gap = PageTokens._gap
    monkeypatch.setattr(PageTokens, "_gap", lambda self, k, block: 1 / 0 if k == 2 * dom.BATCH_ROWS + 5 else gap(self, k, block))
    pages = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["<p>a", "<i>x</i>" * 3 * dom.BATCH_ROWS, "<p>b"])], ["page_id", "html"])
    found = [r for x in dom._rows(pa.int64(), NUMBERS)([pages]) for r in x.select(["page_id", "text", "error"]).to_pylist()]
    assert [(r["page_id"], r["text"]) for r in found] == [(1, "a"), (2, None), (3, "b")] and found[1]["error"].startswith("ZeroDivisionError")


def test_characters_by_closed_names_only():
    html = '<a href="?a=1&amp=2&amp;b">R&amp;D &amp &copy; &copyx &#65; &#66 &nosuch; &</a><script>a && b &amp; &amp</script><!-- &lt -->'
    strings = lambda nodes: [x.text for x in nodes if x.name is None]
    assert strings(parse(html)) == ["R&D & © ©x A B &nosuch; &", "a && b &amp; &amp", " &lt ", ""]
    nodes = parse_closed(html)
    assert strings(nodes) == ["R&D &amp © &copyx A &#66 &nosuch; &", "a && b &amp; &amp", " &lt ", ""]
    assert nodes[1].attrs == {"href": "?a=1&amp=2&b"}


def test_token_texts_of_cut_references_equal_their_sql(spark, tmp_path):
    import duckdb

    from tessella.queries import QUERIES, SQL

    pages = [(1, "<title>a &amp; b&amp</title><p>c &amp;&amp"), (2, "<p>&copy; &middot &quot;x&quot</p>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = sorted(map(tuple, QUERIES["html_token_texts"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(SQL["html_token_texts"]).fetchall()) and len(found) == 3
