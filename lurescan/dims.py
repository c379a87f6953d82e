"""Fixed dimensions: brands, word lists, character tables.

Everything here is a small constant table of values that results depend on.
A user can pass another brand list; see ``Brand`` and ``parse_brands``.
"""

from __future__ import annotations

from collections import namedtuple

Brand = namedtuple("Brand", "ord brand official home word_only")

# Brand name and its official registered domains, in match order.
BRAND_TEXT = """
paypal: paypal.com paypal.me
apple: apple.com icloud.com
icloud: icloud.com apple.com
microsoft: microsoft.com live.com office.com microsoftonline.com sharepoint.com outlook.com office365.com azure.com msn.com bing.com skype.com xbox.com windows.net
office365: office.com office365.com microsoft.com microsoftonline.com
outlook: outlook.com live.com office.com microsoft.com
onedrive: onedrive.com live.com microsoft.com
sharepoint: sharepoint.com microsoft.com
google: google.com google.co.in gmail.com youtube.com googleusercontent.com gstatic.com appspot.com blogspot.com goo.gl g.co
gmail: gmail.com google.com
youtube: youtube.com youtu.be google.com
amazon: amazon.com amazon.in amazon.co.uk amazon.de amazon.co.jp amazon.ca amazon.fr amazonaws.com amazon.jobs a.co
netflix: netflix.com
facebook: facebook.com fb.com meta.com messenger.com fb.me
instagram: instagram.com
whatsapp: whatsapp.com whatsapp.net wa.me
linkedin: linkedin.com lnkd.in
twitter: twitter.com x.com t.co
dropbox: dropbox.com db.tt
docusign: docusign.com docusign.net
adobe: adobe.com
yahoo: yahoo.com yahoo.co.jp
chase: chase.com
wellsfargo: wellsfargo.com
bankofamerica: bankofamerica.com
citibank: citibank.com citi.com
hsbc: hsbc.com hsbc.co.uk hsbc.co.in
dhl: dhl.com dhl.de
fedex: fedex.com
ups: ups.com
usps: usps.com
ebay: ebay.com ebay.co.uk ebay.de ebay.in
spotify: spotify.com
steam: steampowered.com steamcommunity.com
binance: binance.com
coinbase: coinbase.com
metamask: metamask.io
github: github.com github.io
sbi: sbi.co.in onlinesbi.sbi onlinesbi.com sbicard.com
onlinesbi: onlinesbi.sbi onlinesbi.com sbi.co.in
hdfcbank: hdfcbank.com
icicibank: icicibank.com
axisbank: axisbank.com
kotak: kotak.com
pnbindia: pnbindia.in
bankofbaroda: bankofbaroda.in bankofbaroda.com
paytm: paytm.com paytm.in paytmbank.com
phonepe: phonepe.com
irctc: irctc.co.in
uidai: uidai.gov.in
aadhaar: uidai.gov.in
incometax: incometax.gov.in incometaxindia.gov.in
epfindia: epfindia.gov.in
indiapost: indiapost.gov.in
flipkart: flipkart.com
airtel: airtel.in airtel.com
jio: jio.com
"""
# Brands that are ordinary words, matched only as whole words.
WORD_ONLY = frozenset("apple chase steam adobe outlook office365 ups usps dhl jio sbi kotak icloud".split())
# Official domains under which anyone can publish.
MULTI_TENANT = tuple(
    "blogspot.com appspot.com googleusercontent.com sharepoint.com github.io windows.net amazonaws.com".split()
)


def parse_brands(text: str, word_only=frozenset()) -> tuple[Brand, ...]:
    """One brand per line: ``name: official.com other.com``; the first domain is its home."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, domains = line.split(":", 1)
        official = tuple(domains.split())
        out.append(Brand(len(out), name.strip(), official, official[0], name.strip() in word_only))
    return tuple(out)


BRANDS = parse_brands(BRAND_TEXT, WORD_ONLY)


def official_domains(brands=BRANDS) -> tuple[str, ...]:
    return tuple(sorted({d for b in brands for d in b.official}))


# Characters that read like an ASCII letter, written source then target.
CONFUSABLE_PAIRS = (
    "аa еe оo рp сc уy хx іi јj ԁd ѕs һh ӏl ԛq ԝw ɡg ɑa οo αa νv ρp ιi κk τt υu ѵv ıi 0o 1l 3e 5s 7t |l".split()
)
# Letter sequences that read like one letter, applied in this order.
SEQUENCES = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m"))

SEVERITY = {"high": 3, "medium": 2, "low": 1}

# Registered domains of link shorteners.
SHORTENERS = tuple(
    "bit.ly goo.gl tinyurl.com ow.ly t.co is.gd buff.ly adf.ly bit.do cutt.ly rebrand.ly shorturl.at tiny.cc "
    "rb.gy t.ly s.id lnkd.in db.tt qr.ae v.gd x.co soo.gd shorte.st".split()
)
# Platforms where anyone can publish a page.
HOSTING = tuple(
    "000webhostapp.com blogspot.com wordpress.com weebly.com wixsite.com appspot.com firebaseapp.com web.app "
    "github.io netlify.app vercel.app glitch.me herokuapp.com pages.dev workers.dev sharepoint.com "
    "googleusercontent.com sites.google.com codesandbox.io repl.co azurewebsites.net ngrok.io ngrok-free.app "
    "webflow.io godaddysites.com squarespace.com tumblr.com blogger.com mystrikingly.com yolasite.com "
    "square.site r2.dev onrender.com webadorsite.com".split()
)
# Account and security words.
SENSITIVE_WORDS = tuple(
    "login signin logon verify verification account update secure security banking confirm password passwd webscr cmd "
    "wallet unlock suspend recover billing invoice payment authenticate auth validation support customer service free "
    "bonus".split()
)
# Common top-level domains.
COMMON_TLDS = tuple("com org net edu gov in uk de fr it es nl ca au jp br ru ch se no fi dk pl be at io co".split())
# Text that the first-generation shortener flag looks for anywhere in the URL.
V1_SHORTENER_TEXT = tuple(
    "bit.ly goo.gl shorte.st go2l.ink x.co ow.ly t.co tinyurl tr.im is.gd cli.gs yfrog.com migre.me ff.im tiny.cc "
    "url4.eu twit.ac su.pr zpr.io tcrn.ch filoops.info v.gd link.zip.net".split()
)

# Feature names in model order.
V1_FEATURES = tuple(
    "url_length hostname_length path_length count_hyphens count_dots count_at count_questionmark count_equals "
    "count_slashes count_digits has_ip has_https is_shortened".split()
)
FEATURES = tuple(
    "url_length hostname_length path_length count_hyphens count_dots count_at count_questionmark count_equals "
    "count_slashes count_digits has_https is_shortener query_length host_dots subdomain_levels host_hyphens "
    "host_digits digit_ratio host_entropy url_entropy longest_host_token longest_path_token path_segments "
    "count_ampersand count_percent count_underscore count_tilde double_slash_in_path has_port is_ip_host is_punycode "
    "www_prefix tld_common tld_length free_hosting sensitive_words php_or_html email_in_url brand_similarity "
    "lookalike_severity official_brand_domain".split()
)

# Fixed values of the lookalike generator.
GLYPHS = {"o": "0 о", "l": "1", "i": "1 і", "a": "а", "e": "е 3", "m": "rn", "w": "vv", "c": "с", "p": "р"}
COMBO_WORDS = tuple("login secure verify account support update".split())
SWAP_TLDS = tuple("xyz top info online".split())
SUBDOMAIN_BAIT = ("account-verify", "secure-login")
TECHNIQUES = tuple(
    "omission repetition transposition hyphenation replacement homoglyph combosquat subdomain tld-swap".split()
)
