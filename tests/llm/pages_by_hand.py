"""Pages written by hand in the manner of common sites. Marks around text tell what part it is of, and are taken out.

[[article: ...]] is main text; other parts are named by what they are (nav, header, notice, ad, aside, form, share,
footer, comments). One mark is one block.
"""

import re

PAGES = [
    # a newspaper
    """<!doctype html><html lang="en"><head><title>Bridge reopens</title><meta charset=utf-8><style>.x{}</style></head><body>
<div id="cookie-consent"><p>[[notice: We use cookies to measure visits. You can change your choice at any time.]]</p><button>[[notice: Accept all]]</button></div>
<header class="site-header"><a href="/" class="logo">[[header: The Valley Courier]]</a><nav><ul><li><a href="/n">[[nav: News]]</a></li><li><a href="/s">[[nav: Sport]]</a></li><li><a href="/c">[[nav: Culture]]</a></li></ul></nav></header>
<main><article class="story"><h1>[[article: Old stone bridge reopens after two years of repair]]</h1>
<p class="lede">[[article: The bridge over the lower river opened to walkers on Saturday, a month earlier than the council had hoped.]]</p>
<div class="share-tools"><a href="#">[[share: Share]]</a> <a href="#">[[share: Print]]</a></div>
<p>[[article: Engineers replaced forty of the arch stones and lined the piers with steel, the project lead said at the opening.]]</p>
<div class="ad-slot"><p>[[ad: Save 30% on garden furniture this week only]]</p></div>
<h2>[[article: Cars from June]]</h2><p>[[article: Lighter vehicles may cross from the first of June. Buses will keep to the northern road until the surface has settled.]]</p>
<blockquote><p>[[article: It is the same bridge, only it will stand for another century.]]</p></blockquote>
<p>[[article: A fair on the meadow closed the day.]]</p></article>
<aside class="related"><h3>[[aside: More from the valley]]</h3><ul><li><a href="/1">[[aside: Flood wall gets green light]]</a></li><li><a href="/2">[[aside: School choir wins in the capital]]</a></li></ul></aside></main>
<section id="comments"><h3>[[comments: 2 comments]]</h3><div class="comment"><b>[[comments: riverwalker]]</b><p>[[comments: Finally! I used to walk around by the mill every day and it took me an hour.]]</p></div><div class="comment"><b>[[comments: tom_k]]</b><p>[[comments: Would be nice to know what it cost in the end.]]</p></div></section>
<footer><p>[[footer: © 2024 The Valley Courier. All rights reserved.]]</p><a href="/i">[[footer: Imprint]]</a></footer></body></html>""",
    # a blog without article tags
    """<html><body class="home"><div id="wrap"><div id="top"><h1><a href="/">[[header: Notes from a small kitchen]]</a></h1><p>[[header: cooking with what there is]]</p></div>
<div id="menu"><a href="/">[[nav: Start]]</a> <a href="/about">[[nav: About me]]</a> <a href="/archive">[[nav: Archive]]</a></div>
<div id="content"><div class="post"><h2>[[article: Barley soup with leeks]]</h2><p>[[article: My neighbour brought a bag of barley and so there was soup for three days.]]</p>
<p>[[article: Wash the barley, let it stand over night and cook it for forty minutes in salted water.]]</p><ul><li>[[article: 200 g of barley]]</li><li>[[article: two leeks, cut in rings]]</li><li>[[article: a litre of stock]]</li></ul>
<p>[[article: Fry the leeks until they are soft, add the stock and the barley, and season with nutmeg.]]</p></div>
<div id="respond"><h3>[[comments: Leave a reply]]</h3><ol class="commentlist"><li><p>[[comments: Made it yesterday with oats instead, the kids loved it, thank you for the idea]]</p></li></ol><form action="/post"><label>[[form: Your name]]</label><input><textarea>x</textarea><button>[[form: Send]]</button></form></div></div>
<div id="sidebar"><h3>[[aside: Recent posts]]</h3><ul><li><a href="/a">[[aside: Bread without kneading]]</a></li><li><a href="/b">[[aside: What to do with stale cake]]</a></li></ul><div class="newsletter"><p>[[form: Get new recipes by mail once a month.]]</p><form><input type=email><button>[[form: Subscribe]]</button></form></div></div>
<div id="footer">[[footer: Powered by a simple engine, hosted in the cellar]]</div></div></body></html>""",
    # documentation
    """<html><body><div class="topbar"><a href="/">[[header: libqueue]]</a> <a href="/docs">[[nav: Docs]]</a> <a href="/api">[[nav: API]]</a></div><div class="layout"><div class="sidebar-nav"><ul><li><a href="/docs/start">[[nav: Getting started]]</a></li><li><a href="/docs/conf">[[nav: Configuration]]</a></li><li><a href="/docs/faq">[[nav: Questions]]</a></li></ul></div>
<main id="main"><h1>[[article: Configuration]]</h1><p>[[article: The queue reads its settings once at start. Values given on the command line win over the file.]]</p><h2>[[article: File format]]</h2><p>[[article: Settings are lines of a name and a value. Lines that begin with a hash are ignored.]]</p><pre>[[article: depth = 200 workers = 8]]</pre>
<table><tr><th>[[article: name]]</th><th>[[article: meaning]]</th></tr><tr><td>[[article: depth]]</td><td>[[article: how many items may wait]]</td></tr></table><p>[[article: Unknown names stop the program with an error.]]</p></main></div><footer class="foot"><p>[[footer: Released under a free licence. Edit this page on the server.]]</p></footer></body></html>""",
    # a shop's magazine, with a paywall notice and adverts between
    """<html><body><div class="promo-bar">[[notice: Free delivery on all orders above 50 until Sunday]]</div><nav class="main-nav"><a href="/m">[[nav: Men]]</a><a href="/w">[[nav: Women]]</a><a href="/mag">[[nav: Magazine]]</a></nav>
<section class="entry-content"><h1>[[article: How to look after leather boots]]</h1><p>[[article: Leather is skin, and like skin it dries out. A little care after each wet walk keeps it supple for years.]]</p><p>[[article: Brush off the mud when it is dry, never before. Then wipe the boots with a damp cloth and fill them with paper.]]</p>
<div class="sponsored"><a href="/wax">[[ad: Our beeswax balm, now in the large tin. Order today!]]</a></div><p>[[article: Grease goes on in thin layers. Two thin ones are better than one thick one.]]</p></section>
<div class="popup modal"><p>[[notice: You have read your last free article this month. Sign in to go on reading.]]</p><form><input><button>[[form: Sign in]]</button></form></div>
<div class="recommended"><h4>[[aside: You may also like]]</h4><a href="/p1">[[aside: Shoe trees made of cedar]]</a><a href="/p2">[[aside: Wool socks, three pairs]]</a></div>
<div class="site-footer"><a href="/agb">[[footer: Terms]]</a> <a href="/dse">[[footer: Privacy]]</a><p>[[footer: Prices include VAT. Errors excepted.]]</p></div></body></html>""",
    # a forum-like question, the question and its accepted answer are the text
    """<html lang="de"><body><header><a href="/">[[header: Werkstattforum]]</a><form class="search"><input><button>[[form: Suchen]]</button></form></header><nav class="breadcrumb"><a href="/">[[nav: Start]]</a> <a href="/h">[[nav: Holz]]</a></nav>
<article><h1>[[article: Leim hält nicht auf geölter Eiche]]</h1><p>[[article: Ich habe eine Platte aus Eiche geölt und wollte danach eine Leiste aufleimen. Nach einer Woche fiel sie ab.]]</p><p>[[article: Öl sperrt den Leim. Die Fläche muss vorher geschliffen und mit Spiritus abgewischt werden, dann hält es.]]</p></article>
<div class="comments"><p>[[comments: Bei mir hat es auch ohne Spiritus geklappt, aber nur bei altem Öl.]]</p><p>[[comments: Danke, das war es!]]</p></div><aside><h3>[[aside: Ähnliche Fragen]]</h3><ul><li><a href="/q1">[[aside: Welcher Leim für Buche?]]</a></li></ul></aside><footer><a href="/imp">[[footer: Impressum]]</a> <a href="/d">[[footer: Datenschutz]]</a></footer></body></html>""",
    # an encyclopedia's page
    """<html lang="fr"><body><div id="siteNotice"><div class="notice">[[notice: Participez au mois de la contribution !]]</div></div><div id="content" class="body"><h1>[[article: Moulin à marée]]</h1><div id="toc" class="toc"><ul><li><a href="#h">[[nav: Histoire]]</a></li><li><a href="#f">[[nav: Fonctionnement]]</a></li></ul></div>
<p>[[article: Un moulin à marée est un moulin qui tire son énergie de la marée.]]</p><h2 id="h">[[article: Histoire]]</h2><p>[[article: Les premiers moulins de ce type sont attestés au VIIe siècle sur les côtes d'Irlande.]]</p><h2 id="f">[[article: Fonctionnement]]</h2><p>[[article: Un bassin se remplit à marée haute ; l'eau retenue fait tourner la roue quand la mer descend.]]</p></div>
<div id="footer"><ul><li>[[footer: Dernière modification le 3 mai.]]</li><li><a href="/c">[[footer: Contact]]</a></li></ul></div></body></html>""",
]


def page(marked):
    """The page without marks, and its (part, text) in order."""
    parts = [(kind, re.sub(r"\s+", " ", text).strip()) for kind, text in re.findall(r"\[\[(\w+): (.*?)\]\]", marked, re.S)]
    return re.sub(r"\[\[\w+: (.*?)\]\]", r"\1", marked, flags=re.S), parts
