"""Every feature of both variants against a plain version, on whole test pages and on hand-made ones."""

import pytest

from tessella.operators.fast import fast_token_features
from tessella.operators.features import FEATURES, page_token_features

from .conftest import DATA
from .plain_features import first, second

CARD = '<div class="card-title big" id="c1"><span class="p">€ 100.000</span><a href="/a/b/c" class="x title"> Via Roma 1 </a><ul>{}</ul></div>'
PAGES = [
    "<!DOCTYPE html><html><!-- note --><head><style>p{color:red}</style><script>var t = 1.5;</script></head><body><p>one</p></body></html>",
    "<div>" + "".join(CARD.format("".join(f"<li>{x}</li>" for x in (f"{k} locali", "90 m²", "2 bagni", "piano 3"))) for k in range(4)) + "</div>",
    "<ul><li>a</li><li>b</li><li>a</li></ul><section><li>a</li><article>x. y! z?</article></section>",
    '<p style="font-size:12px; margin-top: 1.5em;DISPLAY:none;">x</p><p style="font-size:1.2.3;display: NONE">y</p><p style="">z</p><i style="a:b display:block">w</i><b style="display:inline">v</b><u style="display:inline-block">t</u>',
    "<div>t1<p>u1<b>v1</b>u2</p>t2<p>w1<b>v1</b></p><img src=x><button>go 1</button><i role=button>k</i>t3 <a href='/q/'>l<img></a></div>tail",
    "€ 1 a<p>intro</p><p>1.200 €uro</p><p>3 locali</p><p>bb</p><p>12 LOCALI</p><p>€ 2</p><p>one</p><p>€ 3</p><p>xx</p><p>yy</p>",
    "<div><template>tpl <b>in</b> x</template><template>tpl <template>deep</template></template><script>s1</script>see</div>",
    "<p>aa</p><p>bb</p>", "<b>x</b>", "", "   ", "plain text only", f"<p>{'a' * 500}</p><p>{'b' * 501}</p><p> c d </p>", "<p>a<p>b<p>c<div>d<div>e</div></div>",
    "<html><!-- c --><body><p>x</p>y</body></html>", "<div><div><p>x 1</p></div><div><p>x 1</p></div></div><div><p>x 1</p></div>", "<table><tr><td>1<td>2<tr><td>3</table><nav><a>l</a> <a>l</a></nav>",
]


@pytest.fixture(scope="module")
def pages(spark):
    own = [(-1 - k, html) for k, html in enumerate(PAGES)]
    stored = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    return own + stored


@pytest.mark.parametrize(("features", "plain"), [(page_token_features, first), (fast_token_features, second)])
def test_all_features(spark, pages, features, plain):
    rows = features(spark.createDataFrame(pages, "page_id long, html string")).collect()
    found = {(r.page_id, r.position): r for r in rows}
    wanted = {(page, k): row for page, html in pages for k, row in enumerate(plain(html))}
    assert set(found) == set(wanted) and len(rows) == len(found) > 500
    wrong = {}
    for place, row in wanted.items():
        assert set(row) == set(FEATURES)
        for name in FEATURES:
            if found[place][name] != pytest.approx(float(row[name]), rel=1e-9, abs=1e-9):
                wrong.setdefault(name, (place, found[place].text, found[place][name], row[name]))
    assert wrong == {}
