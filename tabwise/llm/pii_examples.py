"""The labelled table the personal-data model is trained on: sentences with their entities as [kind:text].

Names, places and numbers are invented. Rows without entities show what must be left alone.
"""

LABELLED = """
My name is [name:Ada Brunner] and I live nearby.
my name is [name:Tom Okafor], nice to meet you
Name: [name:Lena Maria Hoff]
Patient name: [name:Victor Dunmore], admitted today
Customer: [name:Iris Vale]
Please ask Mr. [name:Harold Pym] for the keys.
Mrs. [name:Greta Sandoval] called again
Ms. [name:Nora Quill] and Dr. [name:Emil Torres] agreed.
Dr. [name:Paula Renwick] signed the form
Signed by [name:Jon Abara], director
Regards, [name:Mia Lindqvist]
Best wishes, [name:Oscar Bell]
Ich heiße [name:Karl Weidner] und wohne hier.
Mein Name ist [name:Ute Kranz], guten Tag
Herr [name:Anton Vogt] und Frau [name:Elke Brand] kommen.
Je m'appelle [name:Luc Moreau] et je travaille.
Madame [name:Claire Dubost] est absente
Monsieur [name:Henri Valois] arrive
Me llamo [name:Pablo Rueda] y vivo lejos.
Señora [name:Carmen Ibarra] y Señor [name:Luis Montero] firmaron
Address: [address:14 Willow Lane], next to the park
I live at [address:220 Harbour Street] with my family.
Ship it to [address:7 Mill Road, Ashford 20417] please
He moved to [address:1180 North Elm Avenue] last year
send to [address:93 Station Road] before noon
Adresse: [address:Lindenstraße 12, 10969 Berlin]
Ich wohne in der [address:Gartenstraße 4] im Hof.
Elle habite au [address:18 rue des Lilas] à côté
Vivo en la [address:calle Mayor 31] desde enero
Our office is at [address:45 Pine Street, Suite 300] now
Date of birth: [birth:12/04/1987]
DOB: [birth:1979-11-30]
born on [birth:3 March 1990] in the north
She was born on [birth:24.08.1965] at home
dob [birth:07/19/2001]
geboren am [birth:05.06.1958] auf dem Land
né le [birth:14/02/1992] à midi
nacido el [birth:30/09/1983] en casa
Birthday: [birth:May 17, 1974]
SSN: [id:412-55-9031]
my social security number is [id:530-12-8846], keep it safe
social security [id:219-64-7730]
ssn [id:601 44 2398] on file
Passport no. [id:K83920417] expires soon
passport number: [id:C01X77T42]
Ausweis Nr. [id:T220001293] liegt vor
national id [id:29803417] was checked
The [id:308-91-4420] record is closed.
the with of [id:655-20-1187] and then
of the [id:417-83-2296], in that
account number [account:0048 2291 7735] was closed
IBAN [account:DE44 5001 0517 5407 3249 31] belongs to them
IBAN: [account:FR7630006000011234567890189]
bank account [account:7720193355] at the branch
card [account:4532 7720 1935 6601] is mine
Kontonummer: [account:3301928847] der Bank
charge it to [account:5105105105105101] now
and of the [account:6011000990139425] in then
with that [account:3714496353984312], or not
in der [account:4111111111111112] und das
que la [account:30569309025904] de los
[account:2223003122003223] the of and
est [account:5610591081018251].
call me at [phone:(415) 555-0137] tonight
Tel: [phone:030 5557 2210] nur morgens
phone: [phone:555-867-5309] after six
Call [phone:(212) 555-0199] or write
the and [phone:(303) 555-0142] of it
reach us on [phone:020 7946 0958] any time
fax [phone:415.555.0173] is off
mobile [phone:07700 900461] works
Téléphone: [phone:01 42 68 53 00] le matin
teléfono [phone:91 555 47 12] por la tarde
of then [phone:617-555-0186] on that
write to [mail:ada dot brunner at example dot com] soon
mail [mail:tom (at) example (dot) org] please
reach me: [mail:lena [at] mail [dot] example [dot] net] ok
contact [mail:vic AT example DOT com] for it
email is [mail:iris at post dot example dot org] only
of the and in that is with the of
The of and. In that is, with the of then
And the, by this. Of In with. Then it Was
Er und der die. Das ist Ein mit von Zu
Que de la los. El es una Por con para
Le de la et. Les des que En dans Par pour
Licensed under the Apache License, Version 2.0.
Licensed under the MIT License.
This work is licensed under the GNU General Public License, version 3.
Licensed under CC BY-NC 4.0.
Copyright 2019 by the authors, all rights reserved.
Page 14 of 220
Chapter 3, section 12.4
In 1998 there were 1204 of them
It costs 45.99 or 120 for two
between 1914 and 1918 in the west
at 10:30 on Monday, 12 May
On 3 March 2021 the meeting began.
meeting of 12/04/2021 in the hall
Version 3.11.4 of 2023-06-06 came out
about 1,250,000 rows in 35 files
token = "9742a250774262d69ad6a86100194ed53da5a0ef" is set
a hash 5f3759df and 02f67bdb208dd82000ecd1bbc9a75d298c25511b of it
the | of | and | in | that | with
the%%% of&&& and*** in### then
!!! ??? --- *** of and the
The street was long. The road to the house, the avenue of trees.
His name was unknown. The name of the river is old.
She was born in the north and lived at the coast.
It was sent to the office at noon, dot by dot.
The account of the war. A card on the table.
look at the end of it, at the top and at once
Mr. and Mrs. were there; Dr. was not.
10 of 12 and 7 of 9 in 3 or 4 with 100
It has 365 days, 52 weeks and 8760 hours
<p>of the</p> <div class="x">and 12</div>
id 7 of 12, number 44 in the row
The phone rang. Call it what you will.
""".strip().splitlines()
