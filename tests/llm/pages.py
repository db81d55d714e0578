"""Hand-made pages of unrelated forms. A block of main text begins with the sign §, which is taken out before use."""

PAGES = {
    "table layout of the nineties": """<HTML><HEAD><TITLE>My boat page</TITLE></HEAD><BODY BGCOLOR=white><CENTER><FONT SIZE=5>Harbour Notes</FONT></CENTER>
<TABLE BORDER=0 WIDTH=100%><TR><TD VALIGN=top WIDTH=120><A HREF=index.html>Home</A><BR><A HREF=boats.html>Boats</A><BR><A HREF=links.html>Links</A><BR><A HREF=guest.html>Guestbook</A></TD>
<TD><H1>§Painting the hull</H1><P>§Before you start, wash the hull with fresh water and let it dry for two days. Salt that stays under the paint will lift it within a season.
<P>§Sand with a medium paper, then with a fine one. I needed eleven sheets for a boat of six metres, and my brother needed nine.<P>§Two thin coats are better than a thick one. Wait a night between them.</TD></TR></TABLE>
<HR><CENTER><SMALL>Copyright (c) 1998 J. Halloran. All rights reserved.</SMALL></CENTER></BODY></HTML>""",
    "utility classes, nothing told": """<!doctype html><html><body><div class="x1a2b"><div class="q9"><a href="/">Northwind Daily</a></div><div class="q7"><a href="/w">World</a><a href="/b">Business</a><a href="/s">Sport</a><a href="/c">Culture</a></div></div>
<div class="x77f"><div class="k0"><h1>§River ferry to run at night from June</h1><p>§The city council voted on Tuesday to extend the hours of the river ferry, which until now stopped at eight in the evening.</p>
<p>§Supporters said the late boats would help kitchen and hospital staff, many of whom live on the east bank and finish after the last crossing.</p><p>§The first night boat leaves on the first of June. A ticket costs the same as during the day.</p></div></div>
<div class="x90c"><h3>Most read</h3><div class="z1"><a href="/1">Bakery wins prize for rye bread</a></div><div class="z1"><a href="/2">School roof repaired at last</a></div><div class="z1"><a href="/3">Storm closes the coast road</a></div></div>
<div class="x11d"><p>© 2023 Northwind Daily</p><a href="/t">Terms of use</a> <a href="/p">Privacy</a></div></body></html>""",
    "German weekly with readers' letters": """<html lang="de"><body><div id="kopf"><a href="/">Das Wochenblatt</a></div><ul id="menue"><li><a href="/p">Politik</a></li><li><a href="/k">Kultur</a></li><li><a href="/w">Wissen</a></li></ul>
<div id="beitrag"><h1>§Warum die Kraniche früher ziehen</h1><p>§Seit einigen Jahren sammeln sich die Kraniche schon im September am Bodden. Forscher vermuten, dass die milden Winter im Süden eine Rolle spielen.</p>
<p>§An einem Abend im Herbst zählten Freiwillige mehr als zwölftausend Vögel. Das ist ein Drittel mehr als noch vor zehn Jahren, sagt die Leiterin der Station.</p><h2>§Ein Netz aus Beobachtern</h2><p>§Gezählt wird an vierzig Orten zugleich, damit kein Vogel zweimal in die Liste gerät.</p></div>
<div class="kommentare"><h3>Kommentare</h3><div><b>Ute M.</b><p>Sehr schöner Artikel, bei uns im Garten sind sie auch schon vorbeigezogen.</p></div><div><b>Karl</b><p>Das war doch schon immer so, jedenfalls bei meinem Großvater.</p></div></div>
<div id="fuss">© 2021 Das Wochenblatt. Alle Rechte vorbehalten. <a href="/i">Impressum</a></div></body></html>""",
    "software manual": """<!DOCTYPE html><html><head><title>Install</title></head><body><div role="navigation"><ul><li><a href="a">Start</a></li><li><a href="b">Install</a></li><li><a href="c">Configure</a></li><li><a href="d">Reference</a></li></ul></div>
<div role="main"><h1>§Installing from source</h1><p>§You need a compiler and about two gigabytes of free disk space. The build takes ten minutes on a laptop.</p><pre>§make all
make check
make install</pre><p>§If the check fails, read the last lines of the log first:</p><ul><li>§a missing header means that a package is absent</li><li>§a time-out means that the machine is busy</li></ul><p>§Then run the failing test alone.</p></div>
<div role="contentinfo"><p>Powered by Folio. © 2019-2024 the contributors.</p></div></body></html>""",
    "one column of line breaks": """<html><head><title>On keeping bees</title></head><body><table><tr><td><a href="index.html">Home</a></td></tr><tr><td><font size=2>§I kept bees for nine years before I understood what I was doing.<br><br>For the first years I opened the hive every week, because I wanted to see. The bees did not want to be seen. Each time they needed two days to put the nest in order again.<br><br>In the tenth year I broke my arm and could not open the hive all summer. It was the best honey we ever had.</font></td></tr></table></body></html>""",
    "Spanish blog": """<html><body><div class="cabecera"><h2><a href="/">La cocina de Pilar</a></h2><p>Recetas de toda la vida</p></div><div class="contenido"><h1>§Tortilla de patatas de mi abuela</h1><p>§Mi abuela hacía la tortilla los domingos, cuando venían los primos del pueblo y hacía falta algo que alcanzara para todos.</p>
<p>§Pelad un kilo de patatas y cortadlas en láminas finas. Freídlas despacio en aceite abundante, sin que lleguen a dorarse.</p><h3>§Ingredientes</h3><ul><li>§Un kilo de patatas</li><li>§Seis huevos</li><li>§Una cebolla, si os gusta</li></ul><p>§Batid los huevos, mezclad todo y dejad que repose un cuarto de hora antes de cuajar la tortilla.</p></div>
<div class="compartir"><a href="#">Compartir</a> <a href="#">Tweet</a></div><div class="comentarios"><h3>2 comentarios</h3><div class="c"><p>Luis dijo: A mí me sale siempre seca, probaré con más aceite.</p><a href="#">Responder</a></div><div class="c"><p>Ana dijo: Sin cebolla, por favor.</p><a href="#">Responder</a></div></div><div class="pie"><p>© 2016 Pilar. Todos los derechos reservados.</p></div></body></html>""",
    "custom elements and roles": """<html><body><app-shell><header><a href="/">Lumen</a><nav><a href="/t">Topics</a><a href="/a">About</a></nav></header><main><article><h1>§How glass is made flat</h1><p>§For centuries a flat pane was cut from a blown disc, and the thick middle was sold cheaply to taverns.</p><figure><img src="a.jpg"><figcaption>§A float line seen from above.</figcaption></figure><p>§Today the melt floats on a bath of tin. Both sides come out smooth, because gravity and surface tension do the polishing.</p><aside><h4>Sponsored</h4><p>Buy now: the Lumen desk lamp, 20% off this week.</p></aside><p>§The ribbon leaves the bath at six hundred degrees and is cooled slowly over a hundred metres.</p></article></main><footer><p>Subscribe to our newsletter</p><form><input><button>Sign up</button></form><p>© 2022 Lumen Media</p></footer></app-shell></body></html>""",
    "blog with comments in a list": """<html><body><div id="page"><div id="masthead"><h1>Slow Trains</h1><p>Notes from the dining car</p></div><div id="primary"><div class="post"><h2>§Two days to the coast</h2><p>§We left at dawn, and for the first hour nobody spoke. The heater knocked under the bench and the window was white.</p><p>§At the border a guard asked for papers, looked at the cake on the table, and asked for that as well. We gave him a slice.</p><p>§By noon the snow was gone and the fields were the colour of tea.</p></div><ol class="commentlist"><li><div>Marta says:</div><p>I took that train in the eighties, and the cake was better then, I am sure of it.</p></li><li><div>Oskar says:</div><p>Which line is this? I would like to go next spring with my daughter.</p></li></ol><h3>Leave a Reply</h3><form><p>Your email address will not be published.</p><textarea></textarea></form></div><div id="secondary"><h3>Archives</h3><ul><li><a href="#">May 2014</a></li><li><a href="#">April 2014</a></li></ul></div><div id="colophon">Powered by Press and patience</div></div></body></html>""",
    "notice of an office": """<html><body><p><a href="#m">Skip to content</a></p><div><p>We use cookies to make this site work.</p><button>Accept</button></div><div><span>Town of Ashby</span></div><div><ul><li><a href="/">Services</a></li><li><a href="/">Council</a></li><li><a href="/">Contact</a></li></ul></div><div id="m"><h1>§Collection of garden waste</h1><p>§Garden waste is collected every second Wednesday from March to November. Put the brown bin at the kerb before seven in the morning.</p><table><tr><th>§Area</th><th>§First day</th></tr><tr><td>§North</td><td>§6 March</td></tr><tr><td>§South</td><td>§13 March</td></tr></table><p>§Branches must be shorter than a metre and tied with string, not wire.</p></div><div><p>Was this page helpful?</p><a href="/y">Yes</a> <a href="/n">No</a></div><div><p>© Town of Ashby 2020</p><a href="/a">Accessibility</a> <a href="/p">Privacy</a></div></body></html>""",
    "French daily": """<html><body><div class="entete"><a href="/">Le Courrier du Lac</a></div><div class="barre-menu"><a href="/1">Région</a> <a href="/2">Monde</a> <a href="/3">Économie</a> <a href="/4">Sports</a></div><div class="contenu"><h1>§Le marché couvert rouvre ses portes</h1><p>§Après dix-huit mois de travaux, le marché couvert a rouvert samedi devant une foule venue en nombre malgré la pluie.</p><p>§Les commerçants ont retrouvé leurs étals, agrandis et mieux éclairés. « On respire enfin », sourit une fromagère installée là depuis vingt ans.</p><p>§La charpente, classée, a été restaurée à l'identique.</p></div><div class="publicite"><p>Publicité</p><p>Offre spéciale : deux mois gratuits !</p></div><div class="barre-laterale"><h3>À lire aussi</h3><p><a href="/x">Un nouveau pont pour les cyclistes</a></p><p><a href="/y">La piscine fermée jusqu'en mai</a></p></div><div class="pied"><p>© 2018 Le Courrier du Lac. Tous droits réservés.</p></div></body></html>""",
    "nameless divs": """<html><body><div><div>Fernhill Nursery</div><div><a href="/">Plants</a></div><div><a href="/">Tools</a></div><div><a href="/">Visit us</a></div></div><div><div><h1>§When to plant garlic</h1><div>§Garlic wants a cold spell. Plant the cloves in October, a hand apart and two fingers deep, with the tip up.</div><div>§In heavy soil set them on a little sand, or the base will rot in a wet January.</div><div>§Pull the bulbs when the lower third of the leaves is brown, and dry them in the shade for a fortnight.</div></div></div><div><div>Subscribe to our newsletter</div><div><input><button>Go</button></div></div><div>© 2017 Fernhill Nursery Ltd.</div></body></html>""",
    "question with an answer list of links": """<html><body><nav><a href="/">Home</a> <a href="/q">Questions</a></nav><section class="story-wrap"><h1>§Why does bread go stale faster in the fridge?</h1><p>§Starch crystallises again as bread cools, and it does so fastest just above freezing. A fridge is the worst place for a loaf.</p><p>§In the freezer the process stops almost completely, so a frozen loaf, toasted, tastes fresher than a chilled one.</p><blockquote>§Bread is the only food that ages backwards in the oven.</blockquote></section><section class="promo-x"><h2>Recommended for you</h2><ul><li><a href="/1">Why do onions make us cry?</a></li><li><a href="/2">Is sea salt different?</a></li><li><a href="/3">How hot is a chili?</a></li></ul></section><footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy policy</a></li></ul><p>© 2025 Kitchen Answers</p></footer></body></html>""",
}
