"""Card pages in which elements lie in their own kind: they give the records of the plain pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dialects
from marlstone.plans.catalog import SQL, query
from marlstone.plans.pages import _N, ASIA, JP, _flat, _pages

JP_NESTED = {
    0: """<html><body><!-- <div class="td-r"> --><h1> <span><span>{name}</span></span> </h1><div class="RightBox"><div class="TopInfo"><div><span class="type"><span>2&nbsp;</span>進化</span></div><div class="td-r"><div class="in"><div><span class="hp">HP</span></div></div><span class="hp-num">{hp}</span><div><span class="icon icon-none"></span></div><i class="icon icon-fire"></i></div></div>
<h2 class="mt20">特性</h2><h4>Shield</h4><p>Guards <span><span>&amp;</span></span> waits.</p><h2>ワザ</h2><h4><span class="cost"><span class="icon icon-fire"></span><span class="icon icon-none"></span></span>Flare<span class="f_right Text-fjalla"><span>{hp}</span></span></h4><div><div>Burns</div> <b>a lot</b>.</div><h4><span class="icon icon-dragon"></span>Wait</h4>
<h2>進化</h2><div class="evolution evbox"><div><div><a href="#">Nextmon</a></div></div></div><div class="evolution evbox"><div></div><a href="#">Topmon</a><a>X</a></div></div>
<table><tr><th>弱点</th><th><div>抵抗力</div></th><th>にげる</th></tr><tr><td><div><span class="icon-water icon"></span></div>×2</td><td><table><tr><td><span class="icon-psychic icon"></span></td></tr></table>-30</td><td><span class="icon-none icon"></span><div><span class="icon-none icon"></span></div></td></tr></table>
<div class="card"><div><h4>No.{n} Fire</h4><p>高さ：1.5 m 重さ：20.0 kg</p></div></div><div class="subtext"><div><img class="img-regulation" src="x.gif" alt="{code}"></div> 105 / 100 </div><img src="/assets/images/card_images/large/{n}.jpg"><h5>イラストレーター</h5><p><a href="#">Some Artist</a></p></body></html>""",
    1: JP[1].replace('<div class="subtext">', '<div><script>var x = "<div>";</script><div class="subtext"><div></div>').replace("?x\"></div>", "?x\"></div></div>"),
    2: JP[2].replace('<div class="subtext">7/70', '<div><div class="subtext"><div><div>7/70</div></div>').replace("</body>", "</div></body>"),
}
ASIA_NESTED = {
    0: """<html><body><h1><span class="evolveMarker"><span>{stage}</span></span> <span>{name} V</span></h1><p class="mainInfomation"><span class="hitPoint">HP</span><span class="number">{hp}</span><img src="/img/Grass.png"></p><img src="https://asia.pokemon-card.com/{folder}/card-img/{prefix}000{n}.png">
<div class="skillInformation"><div class="head"><h3>{moves}</h3></div><div class="list"><div class="skill"><div class="top"><div><span class="skillName"><span>[特性]</span>  Shield</span></div><span class="skillCost"></span></div><span class="skillDamage"></span><div><p class="skillEffect">Guards.</p></div></div>
<!-- <div class="skill"><span class="skillName">Old</span> --><div class="skill"><div><span class="skillName">Slam</span></div><span class="skillCost"><span><img src="/Fire.png"></span><span><img src="/Colorless.png"></span></span><span class="skillDamage"><span>30+</span></span><div><div><p class="skillEffect">Hits.</p></div></div></div></div><div class="skill"><div><div><span class="skillName">Nap</span></div></div><p class="skillEffect">Sleeps.</p></div></div>
<table><tr><td class="weakpoint"><table><tr><td><img src="/Water.png"></td></tr></table>×2</td><td class="resist">--</td><td class="escape"><div><img src="a.png"></div><div><img src="b.png"></div></td></tr></table>
<section class="expansionColumn"><section><span class="expansionSymbol"><span><img src="/x/expansion_mark_{code}.png"></span></span></section><span class="alpha"><span>h</span></span><span class="collectorNumber">012/071</span></section><span class="rarity"><span>ar</span></span>
<div class="evolution"><div><ul><li><a href="#">Base</a></li></ul></div><ul><li><a href="#">Top</a></li></ul></div><div class="extraInformation"><div><h3>No. {n} Mouse</h3></div><div><p class="size">Tall</p></div><p class="discription">It hides.</p></div></body></html>""",
    1: ASIA[1].replace("<table>", "<div><div></div><table>").replace("<td>tr</td></tr></table>", "<td><div><div>tr</div></div></td></tr></table></div>").replace('<span class="regulationMark">long</span>', '<span class="regulationMark"><span>long</span></span>'),
    2: ASIA[2],
}


@query(SQL["card_pages_jp"])
def card_pages_jp_nested(spark, sf_dir):
    return _flat(dialects.japanese(_pages(spark, sf_dir, JP_NESTED, dialects.card_url("jp", F.col(_N).cast("string")))))


@query(SQL["card_pages_hk"])
def card_pages_hk_nested(spark, sf_dir):
    pages = _pages(spark, sf_dir, ASIA_NESTED, dialects.card_url("hk", F.col(_N).cast("string")), stage="1階進化", folder="hk", prefix="hk", moves="招式", kind="支援者")
    return _flat(dialects.asian(pages, "hk"))


@query(SQL["card_pages_en"])
def card_pages_en_nested(spark, sf_dir):
    pages = _pages(spark, sf_dir, ASIA_NESTED, dialects.card_url("en", F.col(_N).cast("string")), stage="Stage 1", folder="hk-en", prefix="en", moves="Attack", kind="Supporter")
    return _flat(dialects.asian(pages, "en"))
