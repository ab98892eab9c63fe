"""Synthetic labelled texts on which the personal-information model is trained. Everything is made up by a small grammar of our own; no sentence is taken from a corpus. A text is a list of (piece, type or None).

A frame is a sentence with slots. It is written with capitals and punctuation; its spoken form is the same in lower case
and without punctuation, with numbers and addresses said in words.
"""

from __future__ import annotations

import random
import re
from functools import cache

# Frequent given names of several countries, used as a lexicon (several are also common words).
GIVEN = """aaron ada adam ahmed aisha alan alex alice amanda amir amy ana andrea andrew anita anna anthony anya april arthur astrid
aya barbara ben benjamin beth boris brian bruce carlos carmen carol catherine chen chloe chris claire dan daniel david deborah diana diego
dmitri dora dorothy edward elena eli elizabeth ella emily emma eric erik eva faith fatima felix fiona frank gabriel george grace greta hana
hannah hans harry hassan helen henry hope hugo ian ilse ines ingrid irene iris isaac isabel ivan jack jacob jade james jan jane jason
jean jennifer jessica joan john jonas jose joseph joy juan julia karen karl kate katya ken kevin kim lara laura leif leo liam lily
linda lisa lucas lucy luis magda maria marie mark martin mary matthew max may maya mei mia michael mohammed nadia nancy nina noah nora
olga oliver omar oscar pablo pat paul pedro peter petra priya rachel rafael raj ravi robert rosa rose ruth sam sanjay sara sofia
steven sue summer susan tanya tariq thomas tobias tom ulla vera victor wei will william xavier yasmin yuki yusuf zoe""".split()
# Frequent surnames of several countries, used in made-up persons only.
SURNAMES = """adams ali allen anderson baker banerjee becker bell bianchi brown campbell carter castillo chang chavez clark cohen collins cooper costa cruz davis diaz dubois
edwards evans fischer flores foster garcia gomez gonzalez green gupta hall hansen harris hartley hernandez hill hoffman hughes ivanov jackson jansen jenkins johnson jones
kaya keller kelly khan kim king kowalski kumar larsen lee lewis lopez martin martinez mendoza meyer miller mitchell moore morales moreau morgan morris murphy nelson
nguyen novak ortiz parker patel perez petrov phillips price quinn ramirez reed richter rivera roberts robinson rogers romano rossi russell sanchez santos schmidt schneider
scott shah silva singh smith sousa stewart suzuki tanaka taylor thomas thompson torres tran turner virtanen wagner walker wang ward watson weber white williams
wilson wong wood wright yamamoto yilmaz young zhang""".split()  # fmt: skip
PARTICLES = "van von de der den del della di du la le al el bin ibn ter dos da".split()

_ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sh sk sl sm sn sp st sw t th tr v w wh y z".split()
_VOWELS = "a e i o u a e i o ai ea ee ie oa ou y".split()
_CODAS = "b ck d f g ght k l ld ll lm m n nd ng nn nt p r rd rk rl rm rn rt s sh ss st t th x z".split()
_ENDINGS = "berg dale er field ford ham ing land ley man mann mer ner ov ova ridge sen ski son stein ton well wood worth a o i in ez ic".split()
_TOWNS = "ville ham burg ford ton port field bridge mouth wood dale stadt ington".split()
_STREETS = "street avenue road lane drive court place way close boulevard terrace".split()
_SHORT = ["Street", "St.", "St", "Avenue", "Ave", "Ave.", "Road", "Rd", "Rd.", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Place", "Way", "Blvd", "Boulevard", "Terrace", "Close"]
_ONES = "zero one two three four five six seven eight nine".split()
_TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

# Frequent verbs and small words, which follow given names that are also words ("will advise") and stand in the frames' place for any word.
_WORDS = """accept act add advise agree allow answer apply arrange ask assist begin break bring build buy carry cause change charge collect come consider continue correct
cover create cut decide deliver deny describe discuss drop enter expect explain fail fall feel fill find finish fix follow forward give grow happen help include increase insist
keep learn leave lift listen lose make manage match move need notice occur offer order point prepare process produce protect prove provide push raise receive reduce refuse remain
remember remove repeat replace reply request resolve return review save sell serve settle ship show sign solve sort stand submit suggest supply support take teach touch train
treat try update use verify visit wear win wish work about above across after again against along around away back before behind below between beyond down during even ever far
if inside into just less more near off often once only out over past quite rather since soon still such than then though through today together tomorrow under until up very when
while within without""".split()

#: What names of companies, plans and buildings are made of.
_CO_FIRST = "blue brown silver golden green red white north south east west first united national central river lake summit valley harbor oak maple cedar eagle fox lion star sun crown pioneer liberty heritage community family".split()
_CO_SECOND = "shield cross fox oak valley river star stone point bridge harbor ridge lake field care life health trust".split()
_CO_KIND = "insurance mutual health dental group clinic building tower plan partners hospital pharmacy bank center hall house benefits vision life assurance services foundation".split()

#: Slots that are personal, with their types; the other slots are filled without a label.
TYPES = {"<P>": "person", "<F>": "person", "<SUR>": "person", "<G>": "person", "<E>": "email", "<T>": "phone", "<I>": "identity_number", "<S>": "identity_number", "<A>": "address"}

FRAMES: dict[str, list[str]] = {
    "person": """My name is |<P>|.
You are speaking with |<P>|.
I am |<P>|, the account manager.
It is |<P>| again.
This is |<P>|.
This is |<P>|, calling from the front office.
|<P>| speaking, what can I do for you?
Hello |<P>|, good to hear from you.
Good morning, |<P>| here.
Hi, |<P>| at the help desk.
May I talk to |<P>|?
I was told to look for |<P>|.
Would you connect me with |<P>|?
The account belongs to |<P>|.
The insured person is |<P>|.
The subscriber is called |<P>|.
Name on the card: |<P>|.
Name: |<P>
Caller: |<P>
Member: |<P>|.
Supervisor: |<P>|, evening shift
Agent |<P>| took over the call.
Nurse |<P>| picked up.
We talked with |<P>| on Tuesday.
I heard that from |<P>| yesterday.
There is a note for |<P>|.
|<P>| never rang again.
|<P>| wants a copy of the bill.
|<P>| will join later.
|<P>| has not answered so far.
Tell |<P>| that it is done.
Let |<P>| decide.
The appointment is for |<P>|, nobody else.
I call about |<P>|.
I call on behalf of |<P>|.
My husband |<P>| is covered too.
My daughter |<P>| has the same plan.
My son |<P>| lost the card.
They gave it to |<P>| by mistake.
It was approved by |<P>|.
It was written by |<P>| in haste.
The appeal came from |<P>|.
Seen by Dr. |<SUR>| in the morning.
Sent over by Doctor |<SUR>|.
Dr. |<SUR>| wants another test.
Dr. |<F>| is the surgeon.
Mrs. |<SUR>| is waiting.
Is Mr. |<SUR>| the owner?
Mr. |<F>| agrees.
Ms. |<SUR>| disagrees.
Miss |<SUR>| left early.
Professor |<SUR>| said so.
name=|<P>|; role=owner
user=|<P>|; shift=2
speaker: |<P>|; turn 4
Thank you, |<P>|.
Thanks |<G>|.
Yes |<G>|, I can hear you.
So |<G>|, what else?
Sorry |<G>|, say it once more.
|<P>|'s file is open.
It is |<P>|'s turn.
Regards, |<P>
Signed: |<P>
Then |<P>| takes the phone.
A second voice, |<P>|, joins.
She says |<P>| and spells it.
It went from |<P>| to |<P>|.
Both |<P>| and |<P>| are on the call.
Ask either |<P>| or |<P>|.
Who is |<P>|?
Where did |<P>| go?
Do you know |<P>|?
No, I mean |<F>|, not the other one.
Not |<P>|, the sister.
Okay |<G>|, bye.""".split("\n"),
    "email": """Write to |<E>|.
Mail goes to |<E>|.
Send it over to |<E>|, please.
My mail is |<E>|.
email: |<E>
mail=|<E>|; verified
from=|<E>|; subject=question
|<E>| does not work.
Use |<E>| from now on.
The login is |<E>|.
Is |<E>| right?
Copy me at |<E>|, okay?
Nothing came from |<E>| yet.
The old one was |<E>| and it is gone.
You find me under |<E>|.
Answer to |<E>| (|<P>|).
<|<E>|>
They wrote back from |<E>| today.""".split("\n"),
    "phone": """Call me on |<T>|.
My number is |<T>|.
You get us at |<T>| before five.
phone=|<T>|; type=cell
Fax: |<T>
Fax number |<T>|, night and day.
Mobile: |<T>
Tel. |<T>
Dial |<T>| and wait.
|<T>| rings out.
|<T>| is busy.
We tried |<T>| twice.
The direct line is |<T>|.
He left |<T>| as a contact.
She rang from |<T>| today.
Text |<T>| when you are there.
The office (|<T>|) is shut.
Is |<T>| still good?
Back at |<T>| in an hour.
So that is |<T>|, yes?
The other phone is |<T>|, I think.
Ring |<T>| if the call drops.""".split("\n"),
    "identity": """Member number |<I>|.
Member ID: |<I>
The member ID is |<I>|.
My member number is |<I>|, one moment.
The subscriber ID is |<I>|.
Subscriber |<I>| is active.
His social security number is |<I>|.
SSN: |<I>
SSN |<I>|, as stated.
The last form has her social as |<I>|.
Passport |<I>|, valid.
My passport number is |<I>|.
The passport says |<I>|.
Driver's licence: |<I>
Driving license |<I>| shown.
The license number is |<I>|.
The number on my card is |<I>|.
On the card I see |<I>|.
The ID is |<I>|, please check.
Insured person |<I>|, correct?
He gave |<I>| as his identification.
She read out |<I>| as her ID.
patient_id=|<I>|; ok
Patient number |<I>|, room 4.
Identity confirmed with |<I>|.
Identified by |<I>|.
My ID card has |<I>| on it.
So |<I>| is what it says on the card.""".split("\n"),
    "address": """Send it to |<A>|.
Send the card to |<A>|, please.
Our address is |<A>|.
My home address is |<A>|.
She lives at |<A>|.
He moved to |<A>| last year.
Home: |<A>
Address: |<A>
address=|<A>|; type=home
Deliver it to |<A>| by Friday.
|<A>| is my old address.
|<A>| is where I live.
Is it |<A>| or not?
We are at |<A>| now.
The practice is at |<A>|.
The letter went to |<A>| and came back.
They changed it to |<A>|.
Come to |<A>|, the side door.
The bill goes to |<A>|, as before.
The house (|<A>|) was sold.
Bring it to |<A>|, thanks.
It is |<A>|, not the office.
She wrote |<A>|, nothing else.
|<A>|, or so he says.""".split("\n"),
    "other number": """Claim |<N>| is open.
Claim number |<N>|.
The claim number is |<N>|, right?
Claim: |<N>
Ref. |<N>
Reference |<N>| is closed.
Your reference number is |<N>|.
Reference: |<N>
Ticket |<N>| was raised.
Ticket number |<N>|.
The ticket is |<N>|.
Case |<N>|, second review.
Your case number is |<N>|.
Authorization |<N>| runs out soon.
The authorization number is |<N>|.
Prior auth |<N>| granted.
Approval |<N>| for six visits.
Invoice |<N>| is paid.
Order |<N>| was shipped.
Order number |<N>|.
Batch |<N>| is late.
Confirmation number |<N>|.
Tracking number |<N>|, no movement.
Transaction |<N>| failed.
Check number |<N>| was cashed.
Document |<N>|, page 2.
Call id |<N>|, queue 7.
Job |<N>| finished.
Code |<C>| with modifier |<D>|.
Procedure |<C>|.
Diagnosis |<C>|, billed.
It costs |<D>| dollars.
The copay is $|<D>|.00.
It takes |<D>| minutes.
The deductible is $|<D>|,|<C>|.
On |<DATE>| it was sent.
Date of service: |<DATE>
It starts at |<TIME>| sharp.
Version |<VER>| of the file.
at |<TIME>|, 8000 Hz
Room |<D>|, floor |<D>|.
Build |<VER>|, ratio 0.|<D>""".split("\n"),
    "company": """The |<CO>| covers it.
The |<CO>| is closed on Sundays.
|<CO>| will pay the rest.
Press |<D>| for |<CO>|.
Welcome to |<CO>|.
You have reached |<CO>|.
I work for |<CO>|.
I have a plan with |<CO>|.
My plan is |<CO>|.
Is |<CO>| in the network?
|<CO>| sent a letter.
We moved to the |<CO>| last month.
Thank you for calling |<CO>|.
The card is from |<CO>|.
A bill from |<CO>| came in.""".split("\n"),
    "nothing": """May is a busy month for us.
Will you stay on the phone?
Will that be all?
The grace period ends in June.
Mark the second box.
Somebody will look into it and will answer.
They may call and may not.
They will |<W>|.
We will |<W>| and |<W>|.
It may |<W>| |<W>|.
They |<W>| and will |<W>|; that is all.
You can |<W>| it |<W>| or |<W>| it.
If we |<W>| |<W>|, it will |<W>|.
She |<W>|s |<W>| all of it.
They drew a line under it.
Hope that helps.
Have faith, it gets done.
Joy and patience, that is all.
We open in April and close in August.
Turn right at the street and drive on.
Look at the dot on the page.
At the end of the road there is a way out.
It is a long way to drive.
Place the call once more.
The court decides in March.
Close the file, please.
Say two and drive on.
Press five to close the file.
There is one way or two at most.
Wait ten minutes, then place the call.
It is the first of three places in court.
Look at that, a dot at the end.
Meet at noon at the dot.
Say yes or no.
Say or enter the digits, then hash.
For billing say billing.
For anything else press zero.
Please wait for the next free agent.
Nobody is free at the moment.
Your call matters, do not hang up.
The recording starts now.
This call is recorded.
Hold music.
Silence, then a click.
A ring, then a recorded voice.
The same prompt again.
Noise on the line, nothing to hear.
Two people talk at once.
The voice sounds live, with pauses.
Automated voice with a list of options.
Low confidence here.
Music under a voice.
The rep reads the policy aloud.
The rep is polite and slow.
Waiting, waiting.
Um, let me see.
Hmm, that is odd.
Oh, I see.
Yeah, sure.
Yep.
Sure, go ahead.
Best wishes to all.
Closed on Sundays, open on weekdays.
Great, thank you.
Fine, next one.
Exactly.
Uh, I am not sure about that.
Okay, okay, I get it.
Well, that is odd.
Right, so what is next?
Can you hear me now?
Could you say that again?
Which visit do you mean?
What was the date of the visit?
The visit was in October.
The lab result is missing.
The request was denied for lack of records.
They denied it twice.
It needs a new form.
The form has two pages.
Is the provider in the network?
The plan pays eighty percent.
The deductible has been met.
There are twelve visits left.
I can send you the form today.
I will check the status for you.
Let me transfer the call.
She is not in the office.
He is at lunch.
Somebody will get back to you.
We close at nine.
We are closed on Monday.
Thanks for waiting.
Thank you, goodbye.
Have a nice day.
No problem at all.
I do not know.
Never mind.
See above.
No further action.
Follow up next week.
Done on Friday.
None.""".split("\n"),
}
#: How often frames of each kind are drawn.
SHARE = {"person": 30, "email": 9, "phone": 11, "identity": 12, "address": 10, "other number": 16, "company": 9, "nothing": 20}
#: In the spoken form the clauses of notes (name=..; role=..) don't occur.
_NOTE = re.compile(r"[=<;_]")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, *options):
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def invented(self, ending: bool) -> str:
        """A word of one to three syllables that is in no list."""
        parts = [self.r.choice(_ONSETS) + self.r.choice(_VOWELS) for _ in range(self.pick(1, 1, 2) if ending else self.pick(1, 2, 2, 3))]
        return "".join(parts) + (self.r.choice(_CODAS) * self.chance(0.6) + self.r.choice(_ENDINGS) if ending else self.r.choice(_CODAS) * self.chance(0.5))

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.chance(0.55) else self.invented(False)

    def surname(self) -> str:
        """A family name in lower case; a few with an apostrophe, a hyphen or a particle."""
        plain = lambda: self.r.choice(SURNAMES) if self.chance(0.4) else self.invented(True)
        k = self.r.random()
        if k < 0.04:
            return f"{self.pick('o', 'd')}'{plain()}"
        if k < 0.07:
            return f"{plain()}-{plain()}"
        if k < 0.11:
            return f"{' '.join(self.r.sample(PARTICLES, self.pick(1, 1, 2)))} {plain()}"
        return plain()

    def town(self) -> str:
        return self.invented(False) + self.r.choice(_TOWNS)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def shaped(self, shape: str) -> str:
        """Digits for 0 and letters for L."""
        return "".join(self.r.choice("0123456789") if c == "0" else self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "L" else c for c in shape)

    # ---- numbers in words ----

    def say_two(self, n: int) -> str:
        return _ONES[n] if n < 10 else _TEENS[n - 10] if n < 20 else _TENS[n // 10 - 2] + (f" {_ONES[n % 10]}" if n % 10 else "")

    def say_digits(self, text: str, pairs_from: int | None = None) -> str:
        """Digits one by one, doubled ones and, from a place on, pairs as two-digit numbers; letters as letters, the rest left out."""
        zero, out, i = self.pick("zero", "zero", "oh"), [], 0
        say = lambda c: zero if c == "0" else _ONES[int(c)]
        while i < len(text):
            c, two = text[i], text[i : i + 2]
            if pairs_from is not None and i >= pairs_from and re.fullmatch("[1-9][0-9]", two):
                out, i = [*out, self.say_two(int(two))], i + 2
            elif c.isdigit() and two == c + c and self.chance(0.5):
                out, i = [*out, "double", say(c)], i + 2
            else:
                out, i = [*out, *([say(c)] if c.isdigit() else [c.lower()] if c.isalpha() else [])], i + 1
        return " ".join(out)

    # ---- surface forms ----

    def cased(self, name: str) -> str:
        return " ".join(w if w in PARTICLES else re.sub(r"(^|['-])(\w)", lambda m: m[1] + m[2].upper(), w) for w in name.split())

    def person(self, spoken: bool) -> str:
        g, s, k = self.given(), self.surname(), self.r.random()
        if spoken:
            return g if k < 0.3 else f"{g} {self.r.choice('abcdefghijklmnoprstw')} {s}" if k > 0.93 else f"{g} {self.given()} {s}" if k > 0.88 else f"{g} {s}"
        G, S = self.cased(g), self.cased(s)
        if k < 0.08:
            return f"{g} {s}"  # typed without capitals
        forms = ((0.25, G), (0.37, f"{G[0]}. {S}"), (0.48, f"{S}, {G}"), (0.57, f"{G} {S}".upper()), (0.61, f"{G} {self.r.choice('ABCDEFGHJKLMN')}. {S}"), (0.64, f"{G} {self.cased(self.given())} {S}"), (0.66, f"{G}-{self.cased(self.given())} {S}"))
        return next((form for limit, form in forms if k < limit), f"{G} {S}")

    def email(self, spoken: bool) -> str:
        plain = lambda: self.r.choice(SURNAMES) if self.chance(0.4) else self.invented(True)
        g, s, d = self.given(), plain(), plain() + self.pick("", "", "mail", "health", "net", "care")
        if spoken:
            local = self.pick(f"{g} dot {s}", f"{s} underscore {g}", f"{g[0]} {s} {self.say_two(self.r.randrange(10, 100))}", f"{g} dash {s}", g, f"{g[0]} {s}", f"{g} {self.say_two(self.r.randrange(10, 100))}", f"{g} hyphen {s}", f"{s} dot {g} dot {self.r.choice('abcd')}")
            return f"{local} at {d}{self.pick('', '', '', ' dash ' + plain())} dot {self.pick('com', 'org', 'net', 'edu', 'example', 'test', 'invalid', 'co dot uk')}"
        d += self.pick("", "", "", "-" + plain(), "-group", "." + plain())
        top = self.pick("com", "org", "net", "edu", "example", "test", "invalid", "co.uk", "de")
        local = self.pick(f"{g}.{s}", f"{s}_{g}", f"{g[0]}{s}{self.digits(2)}", f"{g[0].upper()}_{s.capitalize()}+{self.pick('bills', 'news', 'claims')}", f"{s}-{g}", g, f"{g}{self.digits(3)}", f"{g[0]}.{s}")
        k = self.r.random()
        text = f"{local} (at) {d}.{top}" if k < 0.12 else f"{local} [at] {d} [dot] {top}" if k < 0.22 else f"{local}@{d}.{top}"
        return text.upper() if self.chance(0.06) else text

    def phone(self, spoken: bool) -> str:
        n = self.pick("2", "3", "4", "6", "7", "8", "9") + self.digits(2) + (self.pick("555") + self.digits(4) if self.chance(0.6) else self.digits(7))
        a, b, c = n[:3], n[3:6], n[6:]
        if spoken:
            k = self.r.random()
            if k < 0.12:
                return f"{a} {b} {c}"
            if k < 0.27:
                return f"{self.say_digits(a + b)} {self.pick('one', 'one', 'two', 'four')} {self.say_two(self.r.randrange(11, 100))}"
            return self.say_digits(n[3:]) if k < 0.4 else self.say_digits(n, self.pick(None, None, None, 6, 8))
        ext = self.chance(0.15) * (self.pick(" ext. ", " ext ", " x", ", ext. ") + self.digits(self.pick(2, 3, 4)))
        own = self.pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", n, f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}") + ext
        return self.pick(*[own] * 8, self.shaped("+49 30 00000 000"), self.shaped("+33 1 00 00 00 00"), self.shaped("+44 20 0000 0000"), self.shaped("020 0000 0000"), self.shaped("+34 600 000 000"))

    def identity(self, spoken: bool) -> str:
        n = self.digits(9)
        if spoken:
            k = self.r.random()
            return f"{n[:3]} {n[3:5]} {n[5:]}" if k < 0.12 else self.say_digits(n) if k < 0.6 else self.say_digits(self.shaped(self.pick("L00000000", "LL0000000", "L000000000000", "LLL000000", "00000000")))
        return self.pick(n, n, n, f"{n[:3]}-{n[3:5]}-{n[5:]}", f"{n[:3]}-{n[3:5]}-{n[5:]}", f"{n[:3]} {n[3:5]} {n[5:]}", *map(self.shaped, (f"{self.pick('MBR', 'MEM', 'SUB', 'PID')}-00000000", "LLL000000000", "LL0000000", "L00000000", "L000-0000-0000", "L000 0000 0000", "L0000 0000 0", "L0000000", "LLL-000000")))

    def other_number(self, spoken: bool) -> str:
        shape = self.pick("000000", "0000000", "00000000", "00000000", "000000000", "0000-00-0000", "000-000-000", "000 000 0000 00", "00000-0000", "LL-00000000", "LLL-000000", "LLL-00000000", "LLL-00000000", "L00000000", "000000000000", "00-000000", "0000 0000")
        return self.say_digits(self.shaped(shape.replace("L", "") if self.chance(0.7) else shape)) if spoken else self.shaped(shape)

    def address(self, spoken: bool) -> str:
        plain = lambda: self.r.choice(SURNAMES) if self.chance(0.3) else self.invented(True)
        s, n, t = plain(), self.r.randrange(11, 9999), self.town()
        if spoken:
            number = self.say_two(n % 90 + 10) if n < 400 else f"{self.say_two(n // 100 % 90 + 10)} {self.say_two(n % 90 + 10)}" if self.chance(0.8) else str(n)
            out = f"{number} {s} {self.pick(*_STREETS)}"
            if self.chance(0.35):
                k = self.r.randrange(2, 40)
                out += f" {self.pick('apartment', 'unit', 'suite')} {self.say_two(k) if self.chance(0.6) else k}"
            return out + (f" {t}" if self.chance(0.35) else "")
        s, t, k = s.capitalize(), t.capitalize(), self.r.random()
        if k < 0.1:
            return f"{self.r.randrange(1, 200)} {self.pick('rue de', 'rue du', 'avenue de')} {s}, {t}"
        if k < 0.2:
            return f"{s}{self.pick('straße', 'weg', 'platz', 'allee')} {self.r.randrange(1, 120)}, {self.digits(5)} {t}"
        if k < 0.3:
            return f"{self.pick('Calle', 'Via', 'Avenida')} {s} {self.r.randrange(1, 120)}{self.pick('', f', {self.r.randrange(1, 9)}º A')}, {t}"
        if k < 0.38:
            return f"Flat {self.r.randrange(1, 30)}, {self.r.randrange(1, 90)} {s} {self.pick('Close', 'Road', 'Court')}, {t}"
        out = f"{n}{self.pick('', '', '', ' N', ' W.')} {s} {self.pick(*_SHORT)}"
        return out + self.pick("", "", f", {t}", f" {self.pick('Unit', 'Apt')} {self.r.randrange(2, 50)}", f", Apt {self.r.randrange(2, 30)}, {t}, {self.pick('NY', 'TX', 'CA', 'QX', 'OH')} {self.digits(5)}", f", {t}, {self.pick('NY', 'TX', 'CA', 'QX')} {self.digits(5)}")

    def company(self, spoken: bool) -> str:
        """Names that look like persons' and are none."""
        name = self.pick(f"{self.invented(True)} {self.r.choice(_CO_KIND)}", f"{self.r.choice(SURNAMES)} {self.r.choice(_CO_KIND)}", f"{self.r.choice(_CO_FIRST)} {self.r.choice(_CO_SECOND)}", f"{self.r.choice(_CO_FIRST)} {self.r.choice(_CO_SECOND)} {self.r.choice(_CO_KIND)}", f"{self.invented(True)} {self.r.choice(_CO_KIND)} {self.pick('plan', 'group', 'center')}", f"{self.r.choice(_CO_FIRST)} {self.r.choice(_CO_KIND)}")
        return name if spoken else name.title()

    # ---- texts ----

    def fill(self, slot: str, spoken: bool) -> str:
        case = (lambda x: x) if spoken else self.cased
        if slot in ("<P>", "<E>", "<T>", "<I>", "<A>", "<N>", "<CO>"):
            return {"<P>": self.person, "<E>": self.email, "<T>": self.phone, "<I>": self.identity, "<A>": self.address, "<N>": self.other_number, "<CO>": self.company}[slot](spoken)
        if slot in ("<F>", "<SUR>", "<G>"):
            return case({"<F>": lambda: f"{self.given()} {self.surname()}", "<SUR>": self.surname, "<G>": self.given}[slot]())
        if slot == "<S>":  # of the form of a social security number
            n = self.digits(9)
            return self.say_digits(n) if spoken else self.pick(f"{n[:3]}-{n[3:5]}-{n[5:]}", f"{n[:3]}-{n[3:5]}-{n[5:]}", f"{n[:3]} {n[3:5]} {n[5:]}")
        if slot == "<W>":
            return self.r.choice(_WORDS)
        if slot == "<C>":
            return self.say_digits(self.digits(5)) if spoken else self.digits(self.pick(3, 5))
        if slot == "<D>":
            return self.say_two(self.r.randrange(2, 95)) if spoken else str(self.r.randrange(2, 95))
        if slot == "<DATE>":
            return f"{self.pick('march', 'july', 'october')} {self.say_two(self.r.randrange(1, 29))}" if spoken else self.shaped(self.pick("00/00/0000", "00-00-0000", "2024-00-00"))
        if slot == "<TIME>":
            return f"{self.say_two(self.r.randrange(1, 12))} {self.say_two(self.r.randrange(10, 59))}" if spoken else self.shaped(self.pick("00:00", "00:00:00.000"))
        if slot == "<VER>":
            return self.say_digits(self.digits(3)) if spoken else self.shaped(self.pick("0.0.00", "0000.00.00", "0.00"))
        return slot

    def scrambled(self) -> str:
        """Words of the frames in no order, with a person, a company or nothing among them: so what its own form tells is also known where the sentence is not."""
        words = _vocabulary()
        some = lambda: " ".join(self.r.choice(words) for _ in range(self.r.randrange(0, 6)))
        middle = self.pick("<F>", "<F>", "<F>", "<F>", "<P>", "<G>", "<T>", "<T>", "<S>", "<S>", "<N>", "<E>", "<A>", "<A>", "", "<CO>", "<CO>", " ".join([self.invented(True)] * self.r.randrange(2, 5)))
        before, after = some(), some()
        if after and self.chance(0.25):
            after = f", {after}"
        frame = "|".join(x for x in (f"{before} " * bool(before), middle, (after if after[:1] == "," else f" {after}") * bool(after), self.pick(".", "?", "")) if x)
        return frame[:1].upper() + frame[1:]

    def frame(self, spoken: bool) -> str:
        if self.chance(0.25):
            return self.scrambled()
        while True:
            frame = self.r.choice(FRAMES[self.r.choices(list(SHARE), list(SHARE.values()))[0]])
            if not spoken or not _NOTE.search(re.sub(r"<[A-Z]+>", "", frame)):
                return frame

    def text(self) -> list[tuple[str, str | None]]:
        spoken = self.chance(0.45)
        out: list[tuple[str, str | None]] = []
        for _ in range(self.pick(1, 1, 2, 2, 3, 4)):
            if out:
                out.append((" ", None))
            for piece in self.frame(spoken).split("|"):
                kind = TYPES.get(piece)
                if kind or piece.startswith("<"):
                    out.append((self.fill(piece, spoken), kind))
                elif spoken:
                    said = re.sub(r" +", " ", re.sub(r"[^\w' ]", "", piece.lower()))
                    out.append((said, None))
                else:
                    out.append((piece, None))
        return [(p, k) for p, k in self.window(out) if p]

    def window(self, pieces: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
        """A third of the texts begin or end in the middle of what is said, as a window of recognised speech does."""
        for at, cut in ((0, r"^.*? (?=\S* )"), (-1, r" \S*$")):
            if pieces and self.chance(0.33) and pieces[at][1] is None:
                for _ in range(self.pick(1, 2, 3)):
                    pieces[at] = (re.sub(cut, "" if at == 0 else " ", pieces[at][0].rstrip(" ") if at else pieces[at][0], count=1), None)
        return pieces


def training_texts(n: int, seed: int = 11) -> list[list[tuple[str, str | None]]]:
    maker = Maker(seed)
    return [maker.text() for _ in range(n)]


@cache
def company_words() -> frozenset[str]:
    return frozenset([*_CO_FIRST, *_CO_SECOND, *_CO_KIND])


@cache
def frame_words() -> frozenset[str]:
    """The words of the frames, companies' kinds included."""
    words = {w for frames in FRAMES.values() for frame in frames for piece in frame.split("|") if not piece.startswith("<") for w in re.findall(r"[^\W\d_]{2,}", piece.lower())}
    return frozenset(words | set(_CO_KIND) | set(_WORDS))


@cache
def _vocabulary() -> list[str]:
    """Words of the frames, without those that are names or part of spoken addresses and numbers."""
    return sorted(frame_words() - set(GIVEN) - set("at dot dash underscore street".split()) - set(_ONES) - set(_TEENS) - set(_TENS))
