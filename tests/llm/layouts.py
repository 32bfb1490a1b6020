"""Pages of layouts that no grammar writes: (name, html, expected text). TUNED were looked at while the grammar was widened, HELD were written
afterwards and not used to change it."""

P=["The harvest came late this year, and the valley waited for the rain.","Nobody in the village could remember a drier spring; the wells were low.","At the end of August clouds rose over the western ridge at last.","It rained for three days, and the river filled its bed again."]
MENU="<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>World</a></li><li><a href='/c'>Sport</a></li></ul></nav>"
FOOT="<footer><p>&copy; 2024 The Daily Valley. All rights reserved.</p></footer>"
def page(body,menu=MENU,foot=FOOT): return f"<!DOCTYPE html><html><head><title>x</title></head><body>{menu}{body}{foot}</body></html>"
TUNED = []
for wrap in (("<article>","</article>"),("<main>","</main>"),("<div class='content'>","</div>"),("<div id='content'>","</div>"),("<section class='post-body'>","</section>")):
    for n in (1,2,3,4):
        TUNED.append((f"div paragraphs {wrap[0]} {n}",page(wrap[0]+"".join(f"<div>{p}</div>" for p in P[:n])+wrap[1])," ".join(P[:n])))
    TUNED.append((f"text straight in {wrap[0]}",page(wrap[0]+P[0]+"<br><br>"+P[1]+wrap[1]),P[0]+" "+P[1]))
    TUNED.append((f"h1 and text {wrap[0]}",page(wrap[0]+"<h1>Late harvest</h1>"+P[0]+wrap[1]),"Late harvest "+P[0]))
    TUNED.append((f"one p {wrap[0]}",page(wrap[0]+f"<p>{P[0]}</p>"+wrap[1]),P[0]))
    TUNED.append((f"refs {wrap[0]}",page(wrap[0]+"<h1>Late harvest</h1>"+f"<p>{P[0]}</p>"+"<ul>"+"".join(f"<li><a href='/r{k}'>{x}</a></li>" for k,x in enumerate(["Report on wells","Rain tables of 2023","The valley's river","A dry spring"]))+"</ul>"+wrap[1]),"Late harvest "+P[0]+" Report on wells Rain tables of 2023 The valley's river A dry spring"))
TUNED.append(("plain divs",page("<div>"+"".join(f"<div>{p}</div>" for p in P)+"</div>")," ".join(P)))
TUNED.append(("divs in body",page("".join(f"<div>{p}</div>" for p in P))," ".join(P)))
TUNED.append(("p in div",page(f"<div><p>{P[0]}</p></div>"),P[0]))
TUNED.append(("p in body",page(f"<p>{P[0]}</p>"),P[0]))
TUNED.append(("p in body, nothing around",page(f"<p>{P[0]}</p>","",""),P[0]))
TUNED.append(("text in body, nothing around",page(P[0],"",""),P[0]))
TUNED.append(("plain text",P[0]+"\n\n"+P[1],P[0]+" "+P[1]))
TUNED.append(("a lone p",f"<p>{P[0]}</p>",P[0]))
TUNED.append(("text in body",page(P[0]+"<p>"+P[1]),P[0]+" "+P[1]))
TUNED.append(("hidden",page(f"<article><h1>Late harvest</h1><p>{P[0]}</p><p hidden>{P[1]}</p><div style='display:none'>{P[2]}</div><p>{P[3]}</p></article>"),"Late harvest "+P[0]+" "+P[3]))
TUNED.append(("nested divs",page("<div class='wrapper'><div class='row'><div class='col'><h2>Late harvest</h2>"+"".join(f"<div class='para'>{p}</div>" for p in P)+"</div><div class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div></div></div>"),"Late harvest "+" ".join(P)))
TUNED.append(("spans",page("<article><h1>Late harvest</h1>"+"".join(f"<div><span>{p}</span></div>" for p in P)+"</article>"),"Late harvest "+" ".join(P)))
TUNED.append(("ad div among divs",page("<article><h1>Late harvest</h1>"+f"<div>{P[0]}</div><div class='ad'>Buy our new garden hose today!</div><div>{P[1]}</div></article>"),"Late harvest "+P[0]+" "+P[1]))
TUNED.append(("table article",page(f"<table><tr><td><h1>Late harvest</h1><p>{P[0]}</p><p>{P[1]}</p></td></tr></table>"),"Late harvest "+P[0]+" "+P[1]))
TUNED.append(("definition list",page(f"<article><h1>Words</h1><dl><dt>Well</dt><dd>{P[1]}</dd><dt>Ridge</dt><dd>{P[2]}</dd></dl></article>"),"Words Well "+P[1]+" Ridge "+P[2]))
TUNED.append(("comments after",page(f"<article><h1>Late harvest</h1><div>{P[0]}</div><div>{P[1]}</div></article><div id='comments'><h3>2 comments</h3><div class='comment'>I liked that.</div><div class='comment'>Me too, very much.</div></div>"),"Late harvest "+P[0]+" "+P[1]))
TUNED.append(("cookie and form",page(f"<div class='cookie-banner'>We use cookies to make this site better for you. <button>OK</button></div><main><h1>Late harvest</h1><div>{P[0]}</div><form action='/n'><p>Get our letter each week.</p><input name='m'></form><div>{P[1]}</div></main>"),"Late harvest "+P[0]+" "+P[1]))
TUNED.append(("header with tagline",page(f"<main><h1>Late harvest</h1>{P[0]}<br><br>{P[1]}</main>","<header><h1>The Daily Valley</h1><p>News since 1901</p></header>"+MENU),"Late harvest "+P[0]+" "+P[1]))

A="The council met on Tuesday to discuss the new bridge."
B="Costs have risen to nine million, said the treasurer."
C="A decision is expected before winter, when the old bridge closes."
HELD = []
def add(n, p, w):
    HELD.append((n, p, w))

add("wordpress",f"<html><body class='home blog'><header class='site-header'><a href='/'>Valley Blog</a></header><div class='site-content'><div class='hentry post-12'><h2 class='entry-title'>The bridge</h2><div class='entry-content'><p>{A}</p><p>{B}</p></div></div><div class='sidebar widget-area'><h3>Archive</h3><ul><li><a href='/1'>May</a></li></ul></div></div><footer class='site-footer'>Powered by a press</footer></body></html>",f"The bridge {A} {B}")
add("forum-like main",f"<html><body><nav class='topnav'><a href='/'>Start</a> <a href='/x'>Topics</a></nav><main><h1>Bridge</h1><div class='text'>{A}</div><div class='text'>{B}</div><blockquote>{C}</blockquote></main></body></html>",f"Bridge {A} {B} {C}")
add("old table page",f"<html><body><table><tr><td class='menu'><a href='/1'>Home</a><br><a href='/2'>News</a></td><td><h1>Bridge</h1><p>{A}<p>{B}<p>{C}</td></tr></table></body></html>",f"Bridge {A} {B} {C}")
add("center and font",f"<html><body><center><h1>Bridge</h1></center><font size=2>{A}<br><br>{B}</font></body></html>",f"Bridge {A} {B}")
add("only h1 and p",f"<h1>Bridge</h1><p>{A}</p><p>{B}</p>",f"Bridge {A} {B}")
add("div soup",f"<html><body><div id='root'><div class='app'><div class='top'><a href='/'>Valley</a></div><div><div><h1>Bridge</h1></div><div><div>{A}</div><div>{B}</div><div>{C}</div></div></div><div class='footer'>&copy; Valley</div></div></div></body></html>",f"Bridge {A} {B} {C}")
add("share bar inside",f"<html><body><article><h1>Bridge</h1><div class='share'><a href='/s'>Share</a> <a href='/t'>Mail</a></div><p>{A}</p><p>{B}</p><div class='related'><h3>Related</h3><ul><li><a href='/o'>Old bridges</a></li></ul></div></article></body></html>",f"Bridge {A} {B}")
add("newsletter inside",f"<html><body><main><h1>Bridge</h1><p>{A}</p><div class='newsletter'><p>Subscribe to our letter and miss nothing.</p></div><p>{C}</p></main></body></html>",f"Bridge {A} {C}")
add("section article",f"<html><body><section><h1>Bridge</h1>{A}<p>{B}</p></section><footer>Imprint</footer></body></html>",f"Bridge {A} {B}")
add("ordered list",f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Steps</h1><ol><li>{A}</li><li>{B}</li></ol></article></body></html>",f"Steps {A} {B}")
add("links in text",f"<html><body><article><h1>Bridge</h1><p>{A} See <a href='/m'>the minutes</a> of the meeting.</p><p><a href='/b'>{B}</a></p></article></body></html>",f"Bridge {A} See the minutes of the meeting. {B}")
add("pre page",f"<html><body><pre>{A}\n{B}</pre></body></html>",f"{A} {B}")
add("cookie first",f"<html><body><div id='cookie-consent'>This site uses cookies. <a href='/p'>Privacy</a></div><div class='page'><h1>Bridge</h1><p>{A}</p></div></body></html>",f"Bridge {A}")
add("comments plain",f"<html><body><div class='story'><h1>Bridge</h1><p>{A}</p><p>{B}</p></div><div class='comments'><p>Too expensive!</p><p>I agree with the treasurer on this.</p></div></body></html>",f"Bridge {A} {B}")
add("two columns",f"<html><body><div class='container'><div class='left'><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div><div class='right'><h1>Bridge</h1><p>{A}</p><p>{C}</p></div></div></body></html>",f"Bridge {A} {C}")
add("figure",f"<html><body><article><h1>Bridge</h1><figure><img src='b.jpg'><figcaption>The old bridge in 1920.</figcaption></figure><p>{A}</p></article></body></html>",f"Bridge The old bridge in 1920. {A}")
