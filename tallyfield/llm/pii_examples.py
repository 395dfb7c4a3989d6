"""The small labelled table that the field of ``pii`` learns from, and one held out from it.

Lines are sentences with slots, ``{slot}`` for personal data and ``{~slot}`` for like things that aren't. Slots are filled from the lists and
forms below by a seeded generator. The held-out table has sentences, names, streets and numbers of its own.
"""

from __future__ import annotations

import random

Row = list[tuple[str, str]]

# Given names, family names, street names and cities; the second of each is held out.
GIVEN = (
    "Anna Maria John James Robert Mary Patricia Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Nancy Daniel Lisa Matthew Betty Anthony Sandra Mark Ashley Donald Emily Steven Paul Andrew Laura Kevin Brian George Carlos Jose Luis Juan Carmen Lucia Pablo Hans Klaus Peter Stefan Ursula Petra Jean Pierre Marie Claire Camille Yuki Wei Priya Omar Fatima Ahmed Olga Ivan Elena".split(),
    "Jane Kim Sam Bob Alice Sophie Julia Martin Diego Sofia Greta Heinz Luc Nadia Raj Mei Aisha Boris Nina Oliver".split(),
)
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Lee Perez Thompson White Harris Clark Lewis Müller Schmidt Schneider Fischer Weber Dubois Moreau Laurent Tanaka Chen Patel Khan Ivanov O'Brien".split(),
    "Young Walker Allen King Wright Torres Nguyen Becker Hoffmann Lefevre Rossi Novak Sato Singh Haddad Petrov McKenna Doe".split(),
)
STREET = ("Oak Maple Main Park Cedar Elm Washington Lake Hill Pine Church River Mill Spring Highland Union Prospect Second Third".split(), "Walnut Chestnut Franklin Sunset Ridge Forest Meadow Lincoln Baker Station".split())
KIND = "Street St. Avenue Ave. Road Rd. Lane Drive Boulevard Blvd Court Terrace Square".split()
CITY = ("Springfield Boston Denver Austin Portland Berlin Madrid Paris".split(), "Dayton Salem Lyon Bonn Leeds Omaha".split())
MONTH = "January February March April May June July August September October November December".split()
HOST = ("gmail example mail post yahoo proton".split(), "outlook company webmail inbox".split())
TOP = "com org net de fr es".split()

#: Sentences to learn from.
LEARN = """
please call {tel} after lunch
call me at {tel} or {tel} today
tel {tel}
phone: {tel}.
her phone number is {tel}, and his is {tel}
reach us at {tel}, we said
fax {tel} for the form
text me on {tel}
my mobile is {tel}; ring before noon
for help dial {tel} now
the desk has {tel} as its telephone
{tel}
ssn {ssn} on the card
her social security number {ssn} was lost
ssn: {ssn}.
social security {ssn}, issued in may
id {ssn1}, was kept
{ssn1}
write to {mail} for more
it is {mail} now
send it to {mail} soon
mail {mail}.
e-mail {mail}, please
reach me via {mail} or {tel}
{title} {family} came in
dear {title} {family}, we write to you
{title} {given} {family} was seen by {title} {family}.
my name is {given} {family} and I live here
name: {given} {family}
contact {given} {family} at {tel}
signed, {given} {family}
the patient {given} {family} was born on {birth}
I met {given} {family} and {given} {family} there
yesterday {given} {family} said so
we asked {given} about it
ask for {given}, please
{given} {family}, {address}
he lives at {address}
she moved to {address}, last year
address: {address}
send the box to {address}.
the office at {address} is closed
born on {birth}
date of birth: {birth}
dob {birth}
his birthday is {birth}, as said
she was born {birth} in a town
account {account}
account number {account}, please
acct no. {account} was closed
pay into {iban} by friday
IBAN {iban}
passport {passport} was found
passport number: {passport}
routing number {routing} and account {account}
password {secret} was set
password: {secret}
password={secret}
token = "{hex}"
api_key = "{hex}"
secret key {hex} leaked
the api key is {key}
passwd={secret} in the file
use {key} as the key
edor token = "{hex}" lyathe
token={hex} in the log
secret={hex}
{mail}
{mail} is his
{ssn} is her ssn, he said
take {ssn} for the social security number
he was at the house and she was at home
we met at noon at the shop on the hill
put a dot at the end of the line, then stop
the dot is small and the line is long
look at example pages and at other pages
a red dot at sea was seen at night
meet at the dot on the map
they sat at {~word}, dot by dot
at {~word}, a dot was seen
he was at sea, dot
the year {~year} had 365 days and 12 months
on {~date} we sold {~amount} of {~amount} units
on {~date} or {~date} at 10:45
it was held on {~date} in a hall
version {~version} or {~version} and 2.0 of it
pages 12-34 and 101-220, in part 3
it cost 12.50 or $1,200.00 in {~year}
room 101, floor 7, seat 22b and gate c4
the score was 3-1 and then 21-14
isbn {~isbn} was printed in {~year}
order {~order} and part 99812-a, lot 7781
order number {~order} was sent
server {~ip} and {~ip} are down
write {~email} or {~email} now
call {~phone} or {~phone} now
card {~card} and {~card} are used
call {~amount} times a day
phone 3 of {~amount} people
the number {~digits} is large, and {~digits} larger
{~digits} The edor was that, lyathe is 5 of the 10 (or 11) there.
on, lyathe {~digits} edor
call the house, then text the rest
the key is under the mat and the token is lost
a password is a secret word, the account said
account for all of it, and name the street
the street is long and the road is wide
the main street of Springfield is long
12 men on the road, and 7 Lanes were closed
5 People came. The Road was long.
his name is known. The end of it
the name of the town is Dayton
she was born in a small town in {~year}
born in {~year}, he grew up there
in May and in March {~year} it rained
The March wind. In June, he said
Les mots de la ligne, avec un point: dans une page.
Und der die das, nicht zu sich; im Haus von der Stadt.
Por las que se dan, no hay nada en la casa.
THE LINE IS LONG!! AND LOUD!! SO IT IS!!
The end. Of the line. Tior the Ndtion was Retionly.
De la Ci and Of The Thretionor
one | two | three | four | and | more
a b c d e f g h i j k
see (above) and (below) or [here] and [there]
10 20 30 40 50 60 and 7 8 9
between 100-200 and 300-4000 were sent
the ratio 16:9, at 1080p, in h264
licensed under CC BY-NC 4.0. See version 3.
commit {~commit} was merged, build {~order}
x = 5 and y = {~amount}
under the Apache License, Version 2.0.
the GNU General Public License, version 3. {~cap} it
{~shout}!! {~shout}.!! AT!! {~shout}!! {~digits}!!
{~cap} erble the st. {~cap}, thedatre
ist sch. {~cap} St. {~cap} it was
the name. {~cap} of it. {~cap} {~word}
{~word} {~cap} {~word}. The {~cap} was {~word}
{~word} key {~word}. {~cap} {~word} road {~word}
{~word} court. {~cap} {~word} way. {~cap}
contact us. {~cap} {~word}
he asked. {~cap} {~word} met {~word}
{~word} called {~word}. {~cap} {~word} {~cap}
May {~word} the {~word}. March {~word} on
{~ip}$$$ {~word}&&& {~cap}### {~digits}%%%
""".strip().split("\n")

#: Sentences held out.
HELD = """
you can reach the clerk under {tel} all day
phone {tel}, then wait
ring {tel} if it breaks
please text {tel}
the form gave {ssn} as the ssn
he wrote ssn {ssn} in the box
forward it to {mail} today
or write {mail}, he said
this is {title} {given} {family} of the bank
dear {given} {family}, thank you
name {given} {family}, dob {birth}
the letter was signed by {given} {family} and {title} {family}
they live at {address} now
deliver to {address}, please
born {birth}, she is the oldest
the date of birth is {birth}
transfer from account {account} today
use iban {iban}, not cash
her passport {passport} expired
password = {secret} for the test
token: {hex}
set api_key={hex} and go
they met at the lake at ten
the dot at the top is red
on {~date} it cost {~amount} in all
the order {~order} of {~year} was late
version {~version} of {~date}
the isbn {~isbn} is wrong
the number {~digits} stood there
a name, a street and an account were asked for
she was born in {~year} and died in {~year}
the phone rang {~amount} times
the token was lost in a street of Lyon
build {~commit} of {~date} failed
The Night was long. Of Men and Mice, and More
""".strip().split("\n")


class _Fill:
    def __init__(self, rng: random.Random, held: int):
        self.r, self.held = rng, held

    def _digits(self, n: int, first: str = "123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choices("0123456789", k=n - 1))

    def _one(self, of) -> str:
        return self.r.choice(of[self.held])

    def tel(self):
        a, b, c = self._digits(3, "23456789"), self._digits(3, "23456789"), self._digits(4)
        return self.r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"1-{a}-{b}-{c}", f"0{a} {b}{c}", f"(0{a[:2]}) {c} {self._digits(4)}"])

    def tel1(self):
        return self.tel()

    def ssn(self):
        a, b, c = self._digits(3, "0123456"), self._digits(2), self._digits(4)
        return self.r.choice([f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}"])

    def ssn1(self):
        return f"{self._digits(3, '0123456')}-{self._digits(2)}-{self._digits(4)}"

    def mail(self):
        g, f, h, t = self._one(GIVEN).lower(), self._one(FAMILY).lower(), self._one(HOST), self.r.choice(TOP)
        at, dot = self.r.choice([(" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
        user = self.r.choice([g, f"{g}.{f}", f"{g[0]}.{f}", f"{g}_{f}", f"{g}{dot}{f}"])
        return f"{user}{at}{h}{dot}{t}"

    def title(self):
        return self.r.choice("Mr. Mrs. Ms. Dr. Mr Mrs Dr Prof. Herr Frau".split())

    def given(self):
        return self._one(GIVEN)

    def family(self):
        return self._one(FAMILY)

    def address(self):
        line = f"{self._digits(self.r.randint(1, 4))} {self._one(STREET)} {self.r.choice(KIND)}"
        line += self.r.choice(["", "", f", Apt {self._digits(2)}", f" Suite {self._digits(3)}"])
        return line + self.r.choice(["", "", f", {self._one(CITY)}", f", {self._one(CITY)}, {self.r.choice(['CA', 'NY', 'TX', 'OH'])} {self._digits(5)}"])

    def birth(self):
        y, m, d = self.r.randint(1930, 2012), self.r.randint(1, 12), self.r.randint(1, 28)
        return self.r.choice([f"{y}-{m:02}-{d:02}", f"{m:02}/{d:02}/{y}", f"{d}.{m}.{y}", f"{d} {MONTH[m - 1]} {y}", f"{MONTH[m - 1]} {d}, {y}", f"on {d} {MONTH[m - 1]} {y}"[3:]])

    def account(self):
        return self._digits(self.r.randint(7, 12), "0123456789")

    def routing(self):
        return self._digits(9, "0123")

    def iban(self):
        n = self._digits(18)
        groups = [n[i : i + 4] for i in range(0, 18, 4)]
        head = self.r.choice(["DE", "FR", "ES", "GB"]) + self._digits(2)
        return self.r.choice([" ", ""]).join([head, *groups])

    def passport(self):
        return self.r.choice("ABCXKL") + self._digits(self.r.randint(7, 8))

    def secret(self):
        return "".join(self.r.choices("abcdefghkmnpqrstuvwxyz", k=self.r.randint(4, 7))) + self._digits(self.r.randint(2, 5)) + self.r.choice(["", "!", "x"])

    def hex(self):
        return "".join(self.r.choices("0123456789abcdef", k=self.r.choice([32, 40, 40, 24])))

    def key(self):
        return self.r.choice(["AKIA", "sk_live_", "ghp_"]) + "".join(self.r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789abcdefghij", k=20))

    # like things
    def year(self):
        return str(self.r.randint(1900, 2024))

    def date(self):
        return self.birth()

    def amount(self):
        return self.r.choice([self._digits(2), self._digits(3), f"{self._digits(1)},{self._digits(3)}", f"{self._digits(2)}.{self._digits(2)}"])

    def version(self):
        return f"{self._digits(1)}.{self._digits(1)}.{self._digits(2)}"

    def isbn(self):
        return f"978-{self._digits(1)}-{self._digits(2)}-{self._digits(6)}-{self._digits(1)}"

    def order(self):
        return self._digits(self.r.randint(5, 8))

    def ip(self):
        return ".".join(str(self.r.randint(1, 255)) for _ in range(4))

    def email(self):
        return f"{self._one(GIVEN).lower()}.{self._digits(2)}@{self._one(HOST)}.example.com"

    def phone(self):
        return f"+{self._digits(1)} ({self._digits(3)}) {self._digits(3)}-{self._digits(4)}"

    def card(self):
        n = self._digits(16)
        return self.r.choice([n, " ".join(n[i : i + 4] for i in range(0, 16, 4))])

    def digits(self):
        return self._digits(self.r.choice([4, 5, 6, 10, 11, 13, 14, 16, 16]))

    def word(self):
        return "".join(self.r.choice(["th", "re", "on", "en", "ti", "or", "le", "sch", "der", "ou", "ña", "é"]) for _ in range(self.r.randint(1, 4)))

    def cap(self):
        return self.word().capitalize()

    def shout(self):
        return self.word().upper()

    def commit(self):
        return "".join(self.r.choices("0123456789abcdef", k=7))


#: Label of the personal slots.
LABEL = {"tel": "tel", "ssn": "ssn", "ssn1": "ssn", "mail": "mail", "title": "name", "given": "name", "family": "name", "address": "address", "birth": "birth", "account": "account", "routing": "account", "iban": "account", "passport": "account", "secret": "secret", "hex": "secret", "key": "secret"}


def table(lines: list[str], times: int, seed: int, held: int) -> list[Row]:
    """Rows of (word, label): each line filled ``times`` over. A word that holds any of a slot has its label."""
    rng = random.Random(seed)
    fill, out = _Fill(rng, held), []
    for line in lines:
        for _ in range(times if "{" in line else 1):
            text, marks, at = "", [], 0
            while (start := line.find("{", at)) >= 0:
                end = line.index("}", start)
                slot = line[start + 1 : end]
                value = getattr(fill, slot.lstrip("~"))()
                text += line[at:start]
                if not slot.startswith("~"):
                    marks.append((len(text), len(text) + len(value), LABEL[slot]))
                text += value
                at = end + 1
            text += line[at:]
            row, place = [], 0
            for word in text.split():
                place = text.index(word, place)
                row.append((word, next((k for a, b, k in marks if place < b and a < place + len(word)), "")))
                place += len(word)
            out.append(row)
    return out


def learn_table() -> list[Row]:
    return table(LEARN, 10, 1, 0)


def held_table() -> list[Row]:
    return table(HELD, 20, 2, 1)
