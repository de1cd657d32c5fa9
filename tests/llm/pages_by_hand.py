"""Pages written by hand, in layouts that the labelled training pages don't follow, and the text of their articles."""

PAGES = [
    (
        """<!doctype html><html><head><title>Keeping bees in town | The Allotment</title></head><body class="single">
<div id="page"><div class="top"><a href="/" class="brand">The Allotment</a><ul class="links"><li><a href="/plots">Plots</a></li><li><a href="/tools">Tools</a></li><li><a href="/about">About us</a></li></ul></div>
<div class="grid"><div class="col-8"><h1>Keeping bees in town</h1>
<p>Two summers ago our society allowed the first hives behind the tool shed, and the committee expected complaints.</p>
<p>There were none. What came instead was a steady stream of questions from children on their way to school.</p>
<h2>Where to put a hive</h2><p>Pick a corner that gets the morning sun and where nobody has to walk past the entrance.</p>
<ul><li>Face the entrance to the south-east</li><li>Leave two metres in front of it free</li><li>Keep water near by</li></ul>
<p>A low hedge makes the bees climb quickly, which keeps them out of people's hair.</p></div>
<div class="col-4"><h3>Latest</h3><ul><li><a href="/1">Slugs again</a></li><li><a href="/2">The water bill explained</a></li><li><a href="/3">Seed swap in March</a></li></ul></div></div>
<div class="base"><p>&copy; The Allotment Society. All rights reserved.</p><a href="/imprint">Imprint</a></div></div></body></html>""",
        ["Keeping bees in town", "Two summers ago our society allowed the first hives behind the tool shed, and the committee expected complaints.", "There were none. What came instead was a steady stream of questions from children on their way to school.", "Where to put a hive", "Pick a corner that gets the morning sun and where nobody has to walk past the entrance.", "Face the entrance to the south-east", "Leave two metres in front of it free", "Keep water near by", "A low hedge makes the bees climb quickly, which keeps them out of people's hair."],
    ),
    (
        """<html><body><nav class="crumbs"><a href="/">Home</a> &gt; <a href="/guides">Guides</a></nav><article><h1>Ten books on rivers</h1>
<p>Rivers have always drawn writers, and the list below is where I would begin if I had to start again.</p>
<ul><li><a href="/b1">The long way down the Severn</a></li><li><a href="/b2">Notes from a ferry</a></li><li><a href="/b3">Salt and silt</a></li><li><a href="/b4">Where the Danube hides</a></li><li><a href="/b5">A year of floods</a></li><li><a href="/b6">The weir keeper's daughter</a></li></ul>
<p>None of them is about fishing, although there is a good deal of fishing in the third.</p></article>
<footer><ul><li><a href="/c">Contact</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
        ["Ten books on rivers", "Rivers have always drawn writers, and the list below is where I would begin if I had to start again.", "The long way down the Severn", "Notes from a ferry", "Salt and silt", "Where the Danube hides", "A year of floods", "The weir keeper's daughter", "None of them is about fishing, although there is a good deal of fishing in the third."],
    ),
    (
        """<html><body><header><a href="/">Institute of Soils</a></header><div class="related-research"><h2>What worms do to clay</h2>
<p>For eight years we weighed the casts that earthworms left on four plots of heavy clay, month by month.</p>
<p>The plots with most worms drained in half the time, even after the wettest winter on record.</p></div>
<footer><p>Institute of Soils, 4 Mill Lane</p></footer></body></html>""",
        ["What worms do to clay", "For eight years we weighed the casts that earthworms left on four plots of heavy clay, month by month.", "The plots with most worms drained in half the time, even after the wettest winter on record."],
    ),
    (
        """<html><body><div class="menu"><a href="/a">Start</a> <a href="/b">Services</a> <a href="/c">Team</a></div><div class="legal"><h1>How a will is proved</h1>
<p>When somebody dies, the person named as executor takes the will to the registry and swears an oath.</p>
<p>If nobody objects within eight weeks, the registry issues the grant and the estate can be divided.</p></div>
<div class="cookie"><p>We use cookies to improve your visit.</p><button>Accept</button></div></body></html>""",
        ["How a will is proved", "When somebody dies, the person named as executor takes the will to the registry and swears an oath.", "If nobody objects within eight weeks, the registry issues the grant and the estate can be divided."],
    ),
    (
        """<html><head><title>Bread in a cold kitchen</title></head><body><main><section id="toc"><h1>Bread in a cold kitchen</h1><p>Dough doesn't mind the cold; it only takes its time, and time is what gives bread its taste.</p>
<p>Mix it in the evening, fold it once before you go to bed, and bake it when you come back from work.</p></section></main>
<section class="comments"><h3>3 comments</h3><div class="c"><b>Ann</b><p>Works for me, thanks a lot!</p></div><div class="c"><b>Joe B</b><p>Mine stuck to the tin. Any ideas what went wrong there?</p></div></section></body></html>""",
        ["Bread in a cold kitchen", "Dough doesn't mind the cold; it only takes its time, and time is what gives bread its taste.", "Mix it in the evening, fold it once before you go to bed, and bake it when you come back from work."],
    ),
    (
        """<html><body><table width="100%"><tr><td colspan="2"><a href="/">News</a> | <a href="/sport">Sport</a> | <a href="/money">Money</a></td></tr><tr><td valign="top" width="70%"><h2>Ferry line to close in May</h2>
<p>The last passenger ferry across the sound will stop running at the end of May, its owners said on Monday.</p><p>Fuel has doubled in price since the contract was signed, and the county declined to pay more.</p><p>Islanders plan to meet on Friday.</p></td>
<td valign="top"><b>Most read</b><ul><li><a href="/x">Storm brings down trees</a></li><li><a href="/y">Harbour fees to rise</a></li></ul></td></tr></table></body></html>""",
        ["Ferry line to close in May", "The last passenger ferry across the sound will stop running at the end of May, its owners said on Monday.", "Fuel has doubled in price since the contract was signed, and the county declined to pay more.", "Islanders plan to meet on Friday."],
    ),
    (
        """<html><body><div id="app"><div class="css-1x2y"><a class="css-9q" href="/">Log in</a><a class="css-9q" href="/j">Join</a></div><div class="css-77a"><div class="css-0b"><h1>Why our tests were slow</h1><div class="css-p">Every run of the suite took forty minutes, and nobody could say why.</div>
<div class="css-p">We measured each step for a week. Two thirds of the time went into starting the same database four hundred times.</div><pre>make test   # 40 min
make fast   # 9 min</pre><div class="css-p">Now it starts once, and each test works in a transaction that is rolled back.</div></div></div>
<div class="css-ft"><a href="/t">Terms</a><a href="/s">Status</a></div></div><script src="/app.js"></script></body></html>""",
        ["Why our tests were slow", "Every run of the suite took forty minutes, and nobody could say why.", "We measured each step for a week. Two thirds of the time went into starting the same database four hundred times.", "make test # 40 min make fast # 9 min", "Now it starts once, and each test works in a transaction that is rolled back."],
    ),
    (
        """<html><body><header class="site"><h1><a href="/">Harbour Post</a></h1><form action="/s"><input name="q"><button>Search</button></form></header>
<article class="post"><h2>A winter on the lightship</h2><p>Between November and March the crew saw nobody but the tender, once a month if the sea allowed it.</p>
<aside class="promo"><p>Subscribe today and read Harbour Post for one month at no cost.</p></aside>
<blockquote><p>You learn to hear the fog before you see it.</p></blockquote><p>The log, kept in pencil, breaks off on the last night of February.</p>
<table><tr><th>Month</th><th>Days of fog</th></tr><tr><td>December</td><td>11</td></tr><tr><td>January</td><td>17</td></tr></table></article>
<div class="share"><a href="/f">Share</a><a href="/m">Mail</a></div><section id="respond"><h3>Leave a reply</h3><form><textarea>Your comment</textarea><input type="submit"></form></section></body></html>""",
        ["A winter on the lightship", "Between November and March the crew saw nobody but the tender, once a month if the sea allowed it.", "You learn to hear the fog before you see it.", "The log, kept in pencil, breaks off on the last night of February.", "Month", "Days of fog", "December", "11", "January", "17"],
    ),
    (
        """<html><body><noscript><p>Please turn on scripts to use this site.</p></noscript><div class="wrap"><ul class="nav nav-tabs"><li><a href="/1">Read</a></li><li><a href="/2">Edit</a></li><li><a href="/3">History</a></li></ul>
<div class="mw-body"><h1>Peat</h1><p>Peat is plant matter that has only partly decayed, for want of air in water-logged ground.</p><p>It forms <a href="/bog">bogs</a>, <a href="/fen">fens</a> and <a href="/moor">moors</a>, and holds more carbon than all forests together.</p>
<h2>Use</h2><p>Cut and dried it was burned for heat; today most of it goes into potting soil.</p><h2>See also</h2><ul><li><a href="/lignite">Lignite</a></li><li><a href="/sphagnum">Sphagnum</a></li><li><a href="/turf">Turf house</a></li></ul></div></div>
<div id="footer"><ul><li>This page was last changed in June.</li><li><a href="/privacy">Privacy policy</a></li></ul></div></body></html>""",
        ["Peat", "Peat is plant matter that has only partly decayed, for want of air in water-logged ground.", "It forms bogs, fens and moors, and holds more carbon than all forests together.", "Use", "Cut and dried it was burned for heat; today most of it goes into potting soil.", "See also", "Lignite", "Sphagnum", "Turf house"],
    ),
    (
        """<html><body><div class="hdr">Quick Fix Forum</div><div class="ad">Cheap tyres, fitted at your door. Order before midnight and save ten per cent.</div>
<div class="story"><h1>Bleeding a radiator</h1><p>Turn the heating off and wait an hour.<p>Open the valve a quarter turn with the key, and hold a cloth below it.<p>When water comes instead of air, close it. That's all there is to it.</div>
<div class="rail"><h4>Trending</h4><p><a href="/a">Damp walls: what helps</a></p><p><a href="/b">Ten uses for vinegar</a></p></div><div class="disclaimer">Nothing on this site is professional advice.</div></body></html>""",
        ["Bleeding a radiator", "Turn the heating off and wait an hour.", "Open the valve a quarter turn with the key, and hold a cloth below it.", "When water comes instead of air, close it. That's all there is to it."],
    ),
]
