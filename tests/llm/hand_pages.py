"""Hand-written pages of many layouts with their main text, independent of the pages that the model is trained on."""

_A = "The harbour was rebuilt in 1887 after the great storm. It has served the fishing fleet ever since."
_B = "Visitors reach the old pier by a footpath along the cliffs, which takes about half an hour."
_C = "In winter the ferries run twice a day; in summer they leave every hour until dusk."
_D = "Nobody knows who carved the stone figures, but most historians date them to the ninth century."
_E = "The council voted on Tuesday to restore the lighthouse, and work is expected to begin in spring."

#: (name, html, blocks of the main text)
PAGES = [
    ("bootstrap grid", f"<html><body><nav class='navbar navbar-default'><ul class='nav'><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav><div class='container'><div class='row'><div class='col-md-8'><h1>The old harbour</h1><p>{_A}</p><p>{_B}</p><p>{_C}</p></div><div class='col-md-4'><h3>Recent posts</h3><ul><li><a href='/1'>Storms</a></li><li><a href='/2'>Boats</a></li></ul><div class='well'><h4>Newsletter</h4><p>Get news by mail.</p><form><input><button>Go</button></form></div></div></div></div></body></html>", ["The old harbour", _A, _B, _C]),
    ("table layout", f"<html><body bgcolor=white><table width=100%><tr><td width=120 valign=top><a href='i.html'>Home</a><br><a href='m.html'>Maps</a><br><a href='l.html'>Links</a></td><td valign=top><h2>The old harbour</h2><p>{_A}<p>{_D}<p>{_C}</td></tr><tr><td colspan=2><center><font size=1>Copyright 1999 J. Smith. All rights reserved.</font></center></td></tr></table></body></html>", ["The old harbour", _A, _D, _C]),
    ("documentation", f"<body><header><a href='/'>Docs</a></header><div class='toc'><ul><li><a href='#a'>Install</a></li><li><a href='#b'>Options</a></li></ul></div><main><h1>Command reference</h1><p>{_B}</p><h2>Install</h2><pre>make all\nmake install</pre><h2>Options</h2><dl><dt>--fast</dt><dd>Skips the checks that take long.</dd><dt>--quiet</dt><dd>Prints errors only, nothing else.</dd></dl></main><footer>Built with tools</footer></body>", ["Command reference", _B, "Install", "make all make install", "Options", "--fast", "Skips the checks that take long.", "--quiet", "Prints errors only, nothing else."]),
    ("comment list", f"<body><div id='page'><div id='content'><div class='post'><h2>Lighthouse to be restored</h2><div class='entry'><p>{_E}</p><p>{_A}</p></div></div><h3 id='comments'>2 Responses</h3><ol class='commentlist'><li><cite>Ann</cite> says: <p>Good news at last. I waited for years.</p></li><li><cite>Bob</cite> says: <p>Who will pay for it all?</p></li></ol><div id='replyform'><h3>Leave a reply</h3><form><textarea></textarea><input type=submit></form></div></div><div id='sidebar'><ul><li><a href='/a'>Archive</a></li></ul></div></div></body>", ["Lighthouse to be restored", _E, _A]),
    ("linked paragraphs", f"<body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav><article><h1>Two stories</h1><p><a href='/1'>{_E}</a></p><p><a href='/2'>{_D}</a></p></article><footer><a href='/i'>Imprint</a></footer></body>", ["Two stories", _E, _D]),
    ("plain article", f"<body><header><h1>Coast News</h1></header><article><h1>Ferries</h1><p>{_C}</p><p>{_A}</p></article><aside><h2>Popular</h2><ul><li><a href='/x'>Ten walks</a></li></ul></aside><footer>&copy; 2021 Coast News</footer></body>", ["Ferries", _C, _A]),
    ("main with sections", f"<body><div role='navigation'><a href='/'>Start</a></div><main><section><h2>History</h2><p>{_A}</p></section><section><h2>Getting there</h2><p>{_B}</p></section></main><div class='cookie-banner'><p>We use cookies. <a href='/c'>More</a></p><button>OK</button></div></body>", ["History", _A, "Getting there", _B]),
    ("wiki", f"<body><div id='mw-navigation'><ul><li><a href='/'>Main page</a></li><li><a href='/r'>Random page</a></li></ul></div><div id='content'><h1>Stone figures</h1><div id='bodyContent'><p>{_D} See <a href='/p'>Pictish stones</a>.</p><h2>Finds</h2><ul><li>The first was found in 1840 by a farmer.</li><li>Another lay under the church floor.</li></ul></div></div><div id='footer'><ul><li>This page was last edited in May.</li><li><a href='/pp'>Privacy policy</a></li></ul></div></body>", ["Stone figures", f"{_D} See Pictish stones.", "Finds", "The first was found in 1840 by a farmer.", "Another lay under the church floor."]),
    ("advert in the text", f"<body><article><h1>The pier</h1><p>{_B}</p><div class='ad-slot'>Buy boots now! Half price.</div><p>{_C}</p><div class='share'><a href='#'>Tweet</a> <a href='#'>Mail</a></div></article></body>", ["The pier", _B, _C]),
    ("blog without article", f"<body><div class='header'><a href='/'>My blog</a></div><div class='blog-post'><h2 class='title'>A walk</h2><p>{_B}</p><p>{_A}</p><blockquote>{_D}</blockquote></div><div class='widget'><h3>Tags</h3><a href='/t'>sea</a> <a href='/u'>walks</a></div></body>", ["A walk", _B, _A, _D]),
    ("bare page", f"<html><body><h1>Notes</h1><p>{_A}<p>{_B}<hr><address>Webmaster, <a href='mailto:x'>mail</a></address></body></html>", ["Notes", _A, _B]),
    ("table in the text", f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Ferry times</h1><p>{_C}</p><table><tr><th>Day</th><th>Leaves</th></tr><tr><td>Monday</td><td>9:30</td></tr></table><p>{_B}</p></article></body>", ["Ferry times", _C, "Day", "Leaves", "Monday", "9:30", _B]),
    ("rights within the text", f"<body><article><h1>Licence</h1><p>{_A}</p><p>All rights reserved.</p></article><footer>&copy; 2020 Someone</footer></body>", ["Licence", _A, "All rights reserved."]),
    ("login box", f"<body><div id='login'><form><p>Please sign in to go on.</p><input><button>Sign in</button></form></div><div id='main'><h1>Minutes</h1><p>{_E}</p><p>{_D}</p></div></body>", ["Minutes", _E, _D]),
    ("newsletter popup", f"<body><div class='modal newsletter'><h3>Stay in touch</h3><p>Our letter comes once a week.</p></div><article class='story'><h1>Storm</h1><p>{_A}</p></article></body>", ["Storm", _A]),
    ("figure", f"<body><article><h1>Stones</h1><figure><img src='s.jpg'><figcaption>The largest of the figures, seen from the east.</figcaption></figure><p>{_D}</p></article><div class='related'><h3>Read on</h3><a href='/q'>More stones</a></div></body>", ["Stones", "The largest of the figures, seen from the east.", _D]),
    ("two columns by id", f"<body><div id='left'><ul><li><a href='/a'>About</a></li><li><a href='/c'>Contact</a></li></ul></div><div id='maincontent'><h1>About us</h1><p>{_E}</p><p>{_C}</p></div></body>", ["About us", _E, _C]),
    ("french", "<body><nav><ul><li><a href='/'>Accueil</a></li></ul></nav><article><h1>Le vieux port</h1><p>Le port fut rebâti en 1887 après la grande tempête. Il sert encore aux pêcheurs.</p></article><footer>&copy; 2019 Le Journal. Tous droits réservés.</footer></body>", ["Le vieux port", "Le port fut rebâti en 1887 après la grande tempête. Il sert encore aux pêcheurs."]),
    ("only a menu", "<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav><footer>&copy; 2019</footer></body>", []),
    ("long list", "<body><article><h1>Rules</h1><ol>" + "".join(f"<li>Rule number {i} says that boats keep to the right.</li>" for i in range(5)) + "</ol></article><div class='sidebar'><p>Advert here.</p></div></body>", ["Rules"] + [f"Rule number {i} says that boats keep to the right." for i in range(5)]),
    ("forum answer", f"<body><div class='topbar'><a href='/'>Forum</a></div><div class='question'><div class='post-text'><p>{_B}</p></div></div><div id='footer'><a href='/h'>Help</a></div></body>", [_B]),
    ("grid, column first", f"<body><div class='container'><div class='row'><div class='col-sm-3'><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div><div class='col-sm-9'><h1>Harbour</h1><p>{_A}</p><p>{_E}</p></div></div></div></body>", ["Harbour", _A, _E]),
    ("three cells", f"<body><table><tr><td><a href='/a'>Home</a><p><a href='/b'>News</a></td><td><h1>Pier</h1><p>{_B}</p><p>{_A}</p></td><td><b>Links</b><br><a href='/c'>Port</a> <a href='/d'>Town</a></td></tr></table></body>", ["Pier", _B, _A]),
    ("references decoded", "<body><article><h1>Fish &amp; chips</h1><p>Salt &lt; vinegar, they say&nbsp;here. It costs &#163;5.</p></article></body>", ["Fish & chips", "Salt < vinegar, they say here. It costs £5."]),
    ("byline and tags", f"<body><article><h1>Lights</h1><div class='byline'>By <a href='/j'>Jo Reed</a></div><p>{_E}</p><div class='tags'><a href='/t1'>coast</a> <a href='/t2'>lights</a></div></article></body>", ["Lights", _E]),
    ("skip link", f"<body><a class='skip' href='#m'>Skip to content</a><main id='m'><h1>Tides</h1><p>{_C}</p></main></body>", ["Tides", _C]),
    ("breadcrumbs", f"<body><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a> &gt; Harbour</div><div class='article-body'><h1>Harbour</h1><p>{_A}</p></div></body>", ["Harbour", _A]),
    ("definition page", f"<body><header><nav><a href='/'>Words</a></nav></header><main><h1>Quay</h1><dl><dt>Meaning</dt><dd>A wall at which boats are tied up.</dd></dl><p>{_B}</p></main></body>", ["Quay", "Meaning", "A wall at which boats are tied up.", _B]),
    ("related stories", f"<body><article><h1>Storm</h1><p>{_A}</p><p>{_D}</p></article><section class='more-stories'><h2>More stories</h2><article><h3><a href='/1'>Boats lost</a></h3><p>Three boats were lost.</p></article></section></body>", ["Storm", _A, _D]),
    ("disqus", f"<body><div class='content'><h1>Walk</h1><p>{_B}</p></div><div id='disqus_thread'><p>Great walk, thanks for it.</p></div><div class='pagination'><a href='/p1'>Previous</a></div></body>", ["Walk", _B]),
    ("paywall", f"<body><div class='story-text'><h1>Vote</h1><p>{_E}</p></div><div class='paywall'><h3>Read on with a subscription</h3><p>One month costs nothing.</p></div></body>", ["Vote", _E]),
]
