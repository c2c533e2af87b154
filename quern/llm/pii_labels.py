"""The labelled table that the personal-information model is trained on.

Each row is a sentence with slots; the slots are filled by rule with invented values, so a
label is the slot's name. Slots named in ``KINDS`` are personal; all other slots are look-
alikes that aren't.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

# Labelled sentences.
SENTENCES = """
My name is {name}.
my name is {name} and I bought it new.
This is {name} writing for my mother.
This is {name}, the second owner.
I spoke with {name} at the front desk.
We talked to {name} in the sales office.
The driver, {name}, was not hurt.
The driver, {name}, was unharmed. {background}
The passenger, {name}, hit the dashboard.
The owner, {name}, was away.
My neighbour {name} had the same trouble.
My brother {name} drove it home.
Dr. {name} told me to come back in a week.
Dr {name} looked at the rash.
Nurse {name} took a sample.
Mr. {name} promised to call back.
Mrs. {name} signed the form.
Ms. {name} wrote down the details.
Miss {name} answered the phone.
Prof. {name} could not explain it.
Regards, {name}
Regards, {name} {background}
Signed, {name}
Signed, {name} {background}
Yours sincerely, {name}
Thank you, {name}
Name: {name}
Patient {name} was seen on Monday.
The manager {name} said it was normal.
Please ask for {name} when you call {phone}.
{name} wrote this report for her father.
{name} saw the whole thing.
{name} witnessed the accident.
{name} was in the car as well.
My passport is {passport}. - {background}
I live at {address}. {background}
Please send the letter to {address}. {background}
The vehicle is parked at {address} for inspection.
The car stood at {address} for a week.
{place} Motors refused to help.
{place} Motors would not take it back. {background}
{place} Motors sent us away. {name} was there too.
Customer Service told me to wait.
Home address {address}, {place}. {background}
Home address {address}, {place}. Regards, {name}
{background} {place} Motors would not take it back.
Note {digits5} – After {d2} minutes of walking it hurts.
[{date}] After {d2} minutes of walking it hurts.
After {d1} minutes of walking I get cramps.
Customer Care passed me to Claims Handling. {background}
Roadside Assistance took two hours.
The Warranty Department never answered.
[{date}] Room {d3}, ward {d1}, bed {d2}.
I gave the keys to {name} and waited.
My number is {phone} if you need more.
My number is {phone}. {background}
My phone number is {phone} if you need me.
Her number is {phone}, his is {phone}.
Call me on {phone}.
Please call {phone} after six.
Tel {phone}
Tel. {phone} {background}
tel {phone} cell: {phone}
Call me on {phone}. {background}
Tel: {phone}, ask for {name}.
Phone: {phone}
Mobile {phone} or e-mail {email}.
Cell: {phone}, evenings only.
Fax {phone}
Reach me after six at {phone}.
They phoned {phone} and left no message.
The callback number {phone} was noted twice.
You can text {phone} at any time.
I can be reached at {phone} or at {email}.
WhatsApp {phone} works too.
E-mail: {email}
Email {email} {background}
E-mail: {email} {background}
Please write to {email} about this.
You can reach me at {email}.
My address for replies is {email}, thank you.
They kept mailing {email} instead of answering.
I sent photos from {email} last week.
Send the report to {email} please.
Contact {email} or call {phone}.
My SSN is {ssn}.
My social is {ssn}.
My social security number is {ssn}.
SSN {ssn} is on file.
(SSN {ssn})
(social {ssn})
(social security number {ssn}) {background}
They asked for my SSN: {ssn}.
They asked for my social: {ssn}.
They asked for my social security number: {ssn}.
Social {ssn} is on file.
Social security number {ssn} is on file.
My NI no. is {nino}.
(NI no. {nino})
NI no. {nino} is on file.
They asked for my NI no.: {nino}.
My national insurance number is {nino}.
National insurance number {nino} is on file.
(national insurance number {nino})
They asked for my national insurance number: {nino}.
My passport is {passport}.
My passport number is {passport}.
Passport {passport} is on file.
Passport number {passport} is on file.
(passport {passport})
(passport number {passport}) {background}
They asked for my passport: {passport}.
They asked for my passport number: {passport}.
My ID card is {card}.
ID card {card} is on file.
(ID card {card})
They asked for my ID card: {card}.
My identity card number is {card}.
My driver's license is {licence}.
Driver's license {licence} is on file.
(driver's license {licence})
They asked for my driver's license: {licence}.
My licence no. is {licence}.
Licence no. {licence} is on file.
(licence no. {licence})
They asked for my licence no.: {licence}.
My driving licence number is {licence}.
My health insurance number is {health}.
Health insurance number {health} is on file.
(health insurance number {health})
They asked for my health insurance number: {health}.
My insurance member number is {member}.
Insurance member number {member} is on file.
(insurance member number {member})
They asked for my insurance member number: {member}.
I live at {address}.
I live at {address} in {place}.
We live at {address}, {place}.
We moved to {address} last spring.
Please send the letter to {address}.
Home address {address}, {place}.
Home address {address} {background}
Address: {address}, {place}
It happened right outside {address} in {place}.
It was parked in front of {address} all night.
It stopped right outside {address}.
It is parked at {address}. {background}
The tow truck took it to {address}.
My mother lives at {address} with {name}.
My VIN ends in {digits7}.
The VIN is {vin}.
The claim number is {d4}-{d4}.
My claim {d4}-{d4} is still open.
The invoice {d4}-{d3} lists part {d2}-{d4}-{d3}.
Part number {d3}-555-{digits5} is on back order.
Part {d3}-{d3}-{digits5} was replaced.
Recall {d2}V-{d3} was mentioned.
Recall {d2}V{d3} covers it.
The batch on the box is LT{digits7}.
The lab sheet {d3}-{d4} is attached.
I read about it on a forum, post #{digits7}.
Order {digits7} never arrived.
It is the same as in questionnaire {digits5}.
Diary entry {digits5}: {background}
Note {digits5} – {background}
[{digits5}] {background}
(log {digits5})
Sent as report {digits5}.
I put it in the symptom app as log {digits5}.
The case number {digits7} was given to me.
The software version is {d2}.{d1}.{d3}.
This was near Exit {d2} on Highway {d2}.
I was on {place} Parkway doing {d2} when it happened.
I was on {street} when it happened.
We were driving down {street} near {place}.
I was at the {place} clinic last week.
The pharmacy at {place} Market had none left.
Customer Care passed me to Warranty Services.
{place} Motors would not take it back.
{place} Auto Repair quoted a high price.
The dealer at {place} asked us to wait.
The trim level is {place} Estate {d3}.
It has {d2},{d3} miles on it.
It has {digits5} miles on it.
They say tyre pressure @ {d2} psi is fine.
The repair cost {d3}.{d2} dollars.
Room {d3}, ward {d1}, bed {d2}.
Blood pressure was {d3} over {d2}.
My temperature was {d2}.{d1} this morning.
I took {d2} mg of {drug} twice.
I took the last tablet on {date}.
My watch counted {digits5} steps the day it started.
My watch counted {d2},{d3} steps the day it started.
The step counter showed {digits5} yesterday.
I walk about {d1},{d3} steps a day.
It happened on {date}.
It began on {d2}.{d2}.2021 around {d1} pm.
It got worse after {date}.
The first time was {date}.
As of {date} nothing has changed.
On {date} it was at its worst.
I have kept notes since {date}.
I last felt well on {date}.
I noticed it on {date}.
Written {date}.
Noted on {date}
Entry of {date}: {background}
Update, {date}. {background}
[{date}] {background}
({date}) {background}
{date}: {background}
[{date}] {background} {background}
{date}: {background} {background}
[{digits5}] Room {d3}, ward {d1}, bed {d2}.
Note {digits5} – {background} {background}
Note {digits5} – Signed, {name}
{background}
{background} {background}
{background} - {background}
""".strip().split("\n")

# Labelled sentences of letters, orders, schools, tenancies and offices, written without a look at any table.
GENERAL = """
Dear {name}, thank you for your letter of last week.
Hello {name}, your parcel is waiting for you.
Hi, I am {name} and I rent the flat upstairs.
Best wishes, {name}
Kind regards {name}
Love, {name}
Sincerely yours, {name}, tel. {phone}
cc: {name}, {name}
From: {name} <{email}>
To: {email}; {email}
Attendees were {name}, {name} and {name}.
The tenant is {name}, born in {place}.
{name} called me back the same evening.
{name} has not answered since March.
{name} and {name} signed the lease together.
{name}'s mother picked up the keys.
I met {name} at the school gate.
Our teacher, {name}, sent the results home.
According to {name}, the heating was never checked.
It was {name} who opened the door.
The keys were left with {name} on the second floor.
Interviewed by {name} on {date}.
Witness: {name}. Officer: {name}.
Contact person {name}, extension {d3}.
Please forward this to {name} in accounts.
Ask {name} or {name} for a copy.
Reviewed and approved by {name}.
My daughter {name} goes to {place} Primary School.
My landlord {name} keeps the deposit.
My husband {name} and I moved here in May.
Her doctor, {name}, wrote a second letter.
Surname and given name: {lastfirst}
{lastfirst} was absent twice.
Passenger: {lastfirst}, seat {d2}A
Applicant {lastfirst}, {address}
Payable to {name}, {address}.
Booked under {name} for two nights.
Emergency contact: {name}, {phone}
The account belongs to {name}, not to me.
Delivered to {name} at {address} this morning.
I, {name}, hereby end my contract.
Ring {phone} and ask for {name}.
My new number: {phone}
You have my number, {phone}, so use it.
Leave a message at {phone} or {phone}.
call {phone} if the bell is broken
Our office line is {phone} from nine to five.
Someone kept ringing from {phone} at night.
He gave {phone} as his contact.
Text only: {phone}.
Home {phone}, work {phone}
I answered {phone} twice but nobody spoke.
Direct dial {phone}
Phone no. {phone} / e-mail {email}
It said to dial {phone} for help.
If it rains, phone me ({phone}).
Whoever finds the bag please call {phone}
Kindly confirm by mail to {email}.
The invoice went to {email} by mistake.
I wrote to {email} three times.
Reply to {email} or by post to {address}.
My login is my address {email}.
Username {email}, order {digits7}.
Write me: {email}
You may share {email} with the committee.
A copy was sent to {email} and {email}.
Not {email} but {email} is right.
I live on the corner, {address}.
My flat is at {address}, third floor.
We have been at {address} for ten years.
The shop moved from {address} to {address}.
Ship it to {address}, {place}.
Billing address: {address}, {place}
Deliver to: {name}, {address}, {place}
The meeting is at {address} at seven.
The accident happened in front of {address}.
Somebody broke into {address} on Friday.
Viewing of {address} on {date}.
Registered office {address}, {place}
Return address {address}
The cat from {address} is missing.
Take the bus to {place} and walk to {address}.
Our house, {address}, has no bell.
Her social security number, {ssn}, was on the form.
SSN: {ssn}
The last page shows the SSN {ssn} of my son.
Tax form with social {ssn} attached.
NI number {nino}
My National Insurance No is {nino}, as you asked.
Passport no. {passport}, issued in {place}.
Passport: {passport}
He travels on passport {passport}.
They copied my passport, number {passport}.
Identity card {card} expired last year.
ID no. {card}
Identity document number {card}, {name}
Driving licence {licence} was shown at the desk.
Licence: {licence}
Her driver's licence, {licence}, is still valid.
Health insurance no. {health}
Insured under {health} since 2019.
Insurance card number {health}, {name}
Member no. {member} of the health fund.
My insurance ID {member} is on the card.
The membership of the health plan is {member}.
The order number {digits7} is still open.
Invoice no. {digits7} of {date} is paid.
Your ticket {d4}-{d4} was closed.
Tracking code {d4} {d4} {d4} shows no movement.
Flight {d3} from {place} was late.
Meter reading {digits5} on {date}.
Customer Service closed ticket {digits7}.
Batch {d3}-{d4} was recalled in {place}.
Room {d3} costs {d2}.{d2} a night.
The total is {d3},{d2} for {d1} items.
Article {d3}-{d2}-{d4} is sold out.
Page {d2} of {d3}, version {d1}.{d1}.{d2}.
Bus {d2} leaves {place} Station at {d2}:{d2}.
We ran {d2} kilometres along {street} on Sunday.
The {place} Library opens at nine on Main Street.
There is a bakery on {street} and a bank near {place} Square.
{place} City Council did not reply.
The New Year concert in {place} was sold out.
Good Morning Radio reported it on {date}.
Spring Cleaning takes place on {date}.
Please read Terms And Conditions before you sign.
The Blue Heron Hotel on {street} is closed.
Serial number {digits7}{d3} is under the lid.
Model {d3}X, colour {d2}, size {d1}.
{street} is closed for works until {date}.
""".strip().split("\n")

# Sentences without personal information.
BACKGROUND = """
The vehicle was taken to the dealer, who could not find a fault.
My son was turning left when the brakes locked up and he hit a fence.
At about 45 miles per hour the engine lost pressure and the van drifted to the right.
We bought the pickup with 25 thousand miles and the fuel pump has given trouble ever since.
The contact stated that the battery failed without any prior noise.
The problem started in December 2006 and the service desk said it was normal.
Nobody was hurt, but the sedan had to be towed because the power window came loose.
Other owners of this hatchback report that the airbag light shut down twice.
A warning lamp came on after driving in heavy rain, followed by a sharp knock.
The mechanic replaced the part under warranty, and two days later it jammed again.
I heard a loud rattle from the rear suspension and pulled over at once.
When climbing a hill, there is a high whine that gets worse in cold weather.
I no longer trust the steering column, because it cut out on a busy road.
The left headlight of my wagon started to smoke while I was idling in traffic.
I feel stiffness in the forehead for three days, together with fever.
My upper arm hurts more whenever I lie down, and lately I have nausea too.
I woke up with headaches and could hardly move my throat.
Tablets from the chemist brought some relief, yet I still have joint pain since Monday.
I am tired all day, I have a dry cough, and my left knee feels heavy.
After 41 minutes of walking I get tingling in my both ankles.
It is a dull ache near my lower back that bothers me every evening.
My appetite is poor and I have been having night sweats since my last trip.
Along with dizziness I also notice a red rash around the chest.
I notice fatigue for about two weeks and I am worried about numbness as well.
A runny nose came back last night, and warm tea does not help much.
""".strip().split("\n")

# Given names, and syllables and endings of invented surnames and places.
GIVEN = "Priyanka Maria Sean Olga Ivan Fatima Aisha Mohammed Ling Wei Hiroshi Yuki Carlos Lucia Pedro Ana Joao Luis Sofia Emma Noah Liam Olivia Ava Ethan Mia Lucas Chloe Leo Ruth Grace Edward Alice Henry Clare Simon Laura Martin Helen George Julia Victor Nina Boris Katya Dmitri Anton Pavel Zofia Jan Piotr Agnes Bela Gabor Ilse Jurgen Uwe Heidi Klaus Birgit Lars Astrid Erik Ingrid Sven Freya Nils Aino Eero Siobhan Declan Aoife Rhys Megan Owen Fiona Angus Isla Samuel Esther Daniel Miriam Jacob Leah Amir Leila Hassan Zainab Yusuf Deepak Anita Rajesh Sunita Arjun Meera Vikram Lakshmi Thanh Linh Minh Somchai Budi Dewi Kwame Ama Chidi Ngozi Tunde Zanele Sipho Thabo Abena Robert Susan James Linda Michael Barbara William Karen Richard Nancy Joseph Betty Charles Sandra Andrew Paul Kevin Brian Jason Amy Rachel Emily Anna Bruno Clara Dario Elena Felix Gita Henrik Ines Jonas Karim Lena Marco Nadia Omar Paula Quentin Rita Stefan Tara Ugo Vera Walid Xavier Yusra Zeno Mary Peter David Sara Thomas Rosa Aiko Chen Priya Kofi".split()
SYLLABLES = "bel cor dar fen gal hol jor kel lam mor nor pas quil rav sten tol ul var wes yor zan brin tre ost".split()
# Common surnames.
SURNAMES = "Smith Jones Brown Taylor Wilson Evans Thomas Johnson Walker Wright Thompson White Hughes Hall Green Harris Clarke Patel Singh Khan Ahmed Begum Nguyen Tran Wang Li Zhang Chen Yang Kim Park Tanaka Suzuki Sato Garcia Martinez Lopez Gonzalez Perez Sanchez Silva Santos Oliveira Costa Pereira Rossi Ferrari Bianchi Romano Müller Schmidt Weber Fischer Wagner Becker Hoffmann Dubois Moreau Laurent Lefebvre Bernard Petit Jansen Visser Bakker Mulder Novak Kowalski Nowak Horvat Ivanov Petrov Popescu Nagy Kovacs Andersson Hansen Nielsen Virtanen Murphy Kelly Byrne Ryan Walsh Campbell Stewart Murray Okafor Mensah Dlamini Mwangi Venkataraman Subramanian Krishnan Chatterjee Banerjee Gupta Sharma Reddy Fernando Perera Cohen Levy Haddad Khalil Brien Donald Angelo Baker Carpenter Cook Turner Mason Fletcher King Young Long Rice Stone Woods Rivers Field Marsh Hill".split()
ENDINGS = "son man berg field ova ini ez etti ander wick ley mere vic sen aya ulla kamp hagen ato eira".split()
PLACES = "Ashford,Milton,Cedar Falls,Grey Harbour,Oakridge,Port Lindon,Northgate,Stonebridge,Lake Morris,Eastvale,Westbury,Red Hollow".split(",")
ROADS = "Street,Road,Avenue,Lane,Drive,Court,Terrace,Close,Way,Blvd,St,Ave,Rd,Boulevard,Square".split(",")
TREES = "Maple Oak Elm River Church Market Bridge Garden Forest Castle Meadow School Hazel Heron Miller Potter".split()
HOSTS = "example.org example.com example.net mail.example post.test inbox.example sub.mail.example box.test".split()


class _Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, pattern: str) -> str:
        """9 is a digit, A a capital letter; all else stands for itself."""
        return re.sub("[9A]", lambda m: str(self.r.randrange(10)) if m.group() == "9" else self.r.choice("BCDEFGHJKLMNPRSTVWXYZ"), pattern)

    def surname(self) -> str:
        kind = self.r.random()
        if kind < 0.06:
            return self.r.choice(["O’", "O'", "Mc", "Mac", "D’", "D'"]) + self.r.choice(SURNAMES)
        if kind < 0.1:
            return f"{self.r.choice(['van', 'de', 'von', 'da', 'del', 'Al', 'El', 'bin', 'van der', 'de la'])} {self.r.choice(SURNAMES)}"
        if kind < 0.3:
            return self.r.choice(SURNAMES)
        one = lambda: (self.r.choice(SYLLABLES) + self.r.choice(["", "", self.r.choice(SYLLABLES)]) + self.r.choice(ENDINGS)).capitalize()
        return one() + (f"-{one()}" if self.r.random() < 0.2 else "")

    def given(self) -> str:
        """A listed given name, or an invented one, so that the list isn't all there is to a name."""
        invented = self.r.choice(SYLLABLES) + self.r.choice(["", "", self.r.choice("aeiou") + self.r.choice("lmnrst")]) + self.r.choice(["a", "o", "i", "en", "ia", "us", "ine", "ard", "ette", "ik", "e", "y", "is", "an"])
        return self.r.choice(GIVEN) if self.r.random() < 0.5 else invented.capitalize()

    def name(self) -> str:
        given = self.given()
        kind = self.r.random()
        if kind < 0.2:
            given = f"{given[0]}."
        elif kind < 0.35:
            given += f"-{self.given()}"
        elif kind < 0.45:
            given += f" {self.r.choice(GIVEN)[0]}."
        return f"{given} {self.surname()}"

    def lastfirst(self) -> str:
        return f"{self.surname()}, {self.given()}"

    def email(self) -> str:
        given, sur = self.r.choice(GIVEN).lower(), re.sub(r"[^a-zü]", "", self.surname().lower().split("-")[0])
        user = self.r.choice([f"{given}.{sur}", f"{given}_{sur}", f"{given}-{sur}", f"{given[0]}{sur}", sur + self.digits("99"), f"{given}+{self.r.choice(['car', 'claims', 'clinic', 'home'])}", given])
        host = self.r.choice(HOSTS)
        kind = self.r.random()
        if kind < 0.08:
            return f"{user} (at) {host}"
        if kind < 0.12:
            return f"{user} [at] {host}"
        if kind < 0.2:
            return f"{user} at {host.replace('.', ' dot ')}"
        if kind < 0.26:
            return f"{user} @ {host}"
        if kind < 0.32:
            return f"{user.capitalize()}@{host.upper()}"
        return f"{user}@{host}"

    def phone(self) -> str:
        out = self.digits(
            self.r.choice(
                ["555-9999", "5559999", "999-9999", "020 7999 9999", "+44 20 7999 9999", "+44 (0)20 7999 9999", "+1 999 999 9999", "(0)9999 999999", "+61 4 9999 9999", "+91 99999 99999", "0999/999999", "+1 999 555 9999", "(999) 555-9999", "(999)555-9999", "999-555-9999", "999.555.9999", "999 555 9999", "9995559999", "1-999-555-9999", "+44 7700 900999", "07700 900999", "+33 1 99 00 99 99", "+49 30 99999999", "0049 30 99999 999", "+31 6 99999999", "01 99 00 99 99", "+1-999-999-9999", "999-999-9999", "+34 999 999 999"]
            )
        )
        return out + (f" ext. {self.digits('999')}" if self.r.random() < 0.12 else "")

    def ssn(self) -> str:
        return self.digits(self.r.choice(["999-99-9999", "999 99 9999", "999999999"]))

    def nino(self) -> str:
        return self.digits(self.r.choice(["AA999999A", "AA 99 99 99 A", "QQ999999A", "QQ 99 99 99 A"]))

    def passport(self) -> str:
        return self.digits(self.r.choice(["A99999999", "AA 9999999", "AA9999999", "999999999"]))

    def card(self) -> str:
        return self.digits(self.r.choice(["99999999-A", "99999999A", "A9999999"]))

    def licence(self) -> str:
        return self.digits(self.r.choice(["A999-9999-9999", "AAAAA999999AA", "AAAAA999999A9AA", "A9999999"]))

    def health(self) -> str:
        return self.digits(self.r.choice(["A999999999", "A99 999 9999"]))

    def member(self) -> str:
        return self.digits(self.r.choice(["9999-999-999-AA", "AAA999999999", "999-99-9999-A"]))

    def street(self) -> str:
        prefix = self.r.choice(["", "", "", "Old ", "North ", "East ", "W. ", "New "])
        word = self.r.choice(TREES) if self.r.random() < 0.6 else self.surname().split("-")[0]
        return f"{prefix}{word} {self.r.choice(ROADS)}"

    def address(self) -> str:
        kind, word = self.r.random(), self.r.choice(TREES) if self.r.random() < 0.6 else self.surname().split("-")[0]
        number = str(self.r.randrange(1, 2000))
        if kind < 0.08:
            return f"Calle {word} {number}"
        if kind < 0.2:
            return f"{word}{self.r.choice(['weg', 'laan', 'straat', 'gasse', 'straße'])} {number}"
        if kind < 0.28:
            return f"{number} rue {self.r.choice(['des', 'de la', 'du'])} {word}s"
        number += self.r.choice(["", "", "", "A", "B", f"-{int(number) + 2}"])
        return f"{number} {self.street()}" + (f", Apt {self.digits('9')}" if self.r.random() < 0.12 else "")

    def place(self) -> str:
        if self.r.random() < 0.5:
            return (self.r.choice(SYLLABLES) + self.r.choice(["brook", "ford", "ham", "ton", "wick", "mere", "by", "field"])).capitalize()
        if self.r.random() < 0.3:
            return f"{self.r.choice('Lake Port Mount Upper Saint Fort East New'.split())} {(self.r.choice(SYLLABLES) + self.r.choice(['an', 'by', 'ton', 'ery', 'well', 'is'])).capitalize()}"
        if self.r.random() < 0.5:
            first = (self.r.choice(SYLLABLES) + self.r.choice(["", self.r.choice(SYLLABLES), "vale", "ham"])).capitalize()
            return f"{first} {self.r.choice('Cross Bend Hollow Falls Hill Heath Bay Green Point Ridge Grove'.split())}"
        return self.r.choice(PLACES)

    def drug(self) -> str:
        return (self.r.choice(SYLLABLES) + self.r.choice(["trazine", "oxin", "amol", "ipril"])).capitalize()

    def vin(self) -> str:
        return self.digits("A9AAA99A9A9999999")

    def date(self) -> str:
        month = self.r.choice("January February March April May June July August September October November December".split())
        day, year = self.r.randrange(1, 29), self.r.randrange(2015, 2025)
        hour = self.r.choice([f"{self.r.randrange(1, 12)}:30 am", f"{self.r.randrange(1, 12)}:00 pm"])
        clock = self.r.choice(["09:30", "14:00", "23:30", "01:00"])
        return self.r.choice([f"{month} {day}, {year}, {hour}", f"{month} {day}, {year} at {hour}", f"{day} {month} {year}, {clock}", f"{day} {month[:3]} {year} {clock}", f"{year}-{day % 12 + 1:02d}-{day:02d} {clock}", f"{year}-{day % 12 + 1:02d}-{day:02d}"])

    def slot(self, name: str) -> str:
        if m := re.fullmatch(r"(?:digits|d)(\d)", name):
            return str(self.r.randrange(1, 10)) + self.digits("9" * (int(m[1]) - 1))
        return self.r.choice(BACKGROUND) if name == "background" else getattr(self, name)()


_AS_KIND = dict.fromkeys(("ssn", "nino", "passport", "card", "licence", "health", "member"), "id_number") | {"lastfirst": "name"}


def labelled_table(seed: int = 7, copies: int = 30, sentences: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): every sentence ``copies`` times with other values, a fifth each in one letter case.

    ``sentences`` are all of them unless some are given, as to test on those left out.
    """
    f = _Filler(seed)
    rows = []
    for _ in range(copies):
        for sentence in SENTENCES + GENERAL if sentences is None else sentences:
            text, spans = "", []
            for k, part in enumerate(re.split(r"\{(\w+)\}", sentence)):
                if k % 2:
                    value = f.slot(part)
                    kind = _AS_KIND.get(part, part)
                    if kind in KINDS:
                        spans.append((len(text), len(text) + len(value), kind))
                    part = value
                text += part
            before = f.r.choice(BACKGROUND) + " " if f.r.random() < 0.4 else ""
            after = " " + f.r.choice(BACKGROUND) if f.r.random() < 0.4 else ""
            spans = [(a + len(before), b + len(before), kind) for a, b, kind in spans]
            text = before + text + after
            case = f.r.random()
            folded = text.lower() if case < 0.2 else text.upper() if case < 0.4 else text
            rows.append((folded if len(folded) == len(text) else text, spans))
    return rows
