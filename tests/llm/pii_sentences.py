"""Sentences with marked mentions, written by hand for the test alone: {kind|text}, kind by its first letter.

p person, t phone, e e-mail, a address, i identity number. None of them is, or is modelled on, a training sentence.
"""

LETTERS = {"p": "person", "t": "phone", "e": "email", "a": "address", "i": "id_number"}

MARKED = r"""
Yesterday {p|Nikolai Petrov} rebooted the storage head.
The slides were prepared by {p|Margaret O'Sullivan} over the weekend.
I had lunch with {p|Tomasz Wieczorek}, who knows the cluster well.
Nobody but {p|Ingeborg Halvorsen} has the root password.
Could someone ask {p|Rajesh Khanna} whether the licence was renewed?
Apparently {p|Beatrice Fontaine} never received the parcel.
Minutes taken by {p|K. R. Thompson}.
My supervisor is {p|Hiroshi Tanaka} and my mentor is {p|Abigail Stern}.
Present: {p|Aaron Feldman}, {p|Lucia Moretti}, {p|Pieter de Vries}.
{p|Oluwaseun Adeyemi} will take over from {p|Greta Nyström} in March.
We are grateful to {p|Samuel Okafor} and {p|Yi Zhang} for fruitful discussions.
Credit goes to {p|Dmitri Volkov}.
Congratulations to {p|Isabel Marquez} on her promotion!
The complaint was filed by {p|Harold Pembroke} on 3 May.
Dr. {p|Whitfield} was on leave, so Professor {p|Castellano} signed instead.
Mrs. {p|Albrecht} from accounting called twice.
Please remind Mr. {p|Nakamura} of the deadline.
Hi {p|Jennifer Caldwell}, the files are ready.
Dear {p|Anton Berger},
Sincerely, {p|Francesca Bianchi}
This was first noticed by {p|M. Laurent} in 2019.
According to {p|J. P. Morales} the map is wrong.
{p|Petersen, Mikkel} has left the group.
Speaker: {p|Cho, Min-ji}
Supervised by {p|Sophie van Dijk} until last summer.
When {p|Ellen Brodeur} arrived, the lights were off.
Both {p|Karim Haddad} and {p|Leonie Fischer} voted against it.
Reviewer two is obviously {p|Stanley Whitaker}.
The account of {p|Mohammed El-Sayed} was suspended.
Birthday cake for {p|Zsofia Nagy} in the kitchen at four.
Meeting with {p|Andreas Schuster} moved to Thursday.
Driver: {p|William T. Harper}
Next of kin: {p|Dorothy Lindgren}, {t|+1 (415) 555-0132}
Patient {p|Esther Goldblum} was discharged on Tuesday.
The invoice was addressed to {p|Gareth Llewellyn}, {a|27 Castle Street, Aberystwyth SY23 1DT}.
Our contact at the vendor is {p|Priscilla Monroe} ({e|p.monroe@vendor-mail.com}).
Owner={p|Ricardo Fuentes}; mail={e|ricardo.fuentes@correo.mx}
Talk to {p|Benedikt Krause} before you delete anything.
I borrowed the adapter from {p|Charlotte Dubois}.
Nominated by {p|Elias Lundberg}; seconded by {p|Victoria Ashcroft}.

My social security number reads {i|123-45-6789}.
US passport {i|483920175} expired last week.
Driving license {i|D1234567} was shown at the gate.
Her SSN ({i|078-05-1120}) must not be stored here.
The applicant's national insurance number is {i|AB 12 34 56 C}.
Tax number of the contractor: {i|912-70-1234}.
Passport: {i|C01X00T47}
We still need the passport number; it should be {i|K8765432}.
ID card number {i|T220001293} was copied by mistake.
Social Security No: {i|219-09-9999}
SSN={i|457-55-5462}
Identity card no. {i|7301234567} belongs to the visitor.
Her passport (no. {i|P4366918}) was scanned.
National ID {i|850112-1234} on record.
Driver's license number {i|F255-9215-0094} is on file.
The form asks for a tax ID, mine is {i|98-7654321}.
NINO: {i|QQ123456B}
Please redact the social security number {i|001-01-0001} from the scan.
Sein Personalausweis hat die Nummer {i|L01X00T471}.
Meine Steuernummer lautet {i|21/815/08150}.
Steuer-Identifikationsnummer: {i|86 095 742 719}
Der Reisepass {i|C4J9K2M71} ist abgelaufen.
Sozialversicherungsnummer {i|65 170839 J 003} eingetragen.
Mon numéro de sécurité sociale est le {i|1 85 05 78 006 084 36}.
Passeport numéro {i|12AB34567} délivré à Lyon.
Sa carte d'identité porte le numéro {i|880692310285}.
Mi DNI es {i|12345678Z}.
El NIE del becario es {i|X1234567L}.
Pasaporte número {i|AAB123456} caducado.
Número de la seguridad social: {i|28 12345678 40}

You can reach the night desk at {t|0800-123-4567}.
My Indian number is {t|+91 98765 43210}.
Call {t|(212) 555-0187} after six.
Her mobile: {t|+44 7700 900123}
Office phone {t|555-867-5309 ext. 22} is out of order.
Tel.: {t|+49 89 1234567-12}
Dial {t|1-800-555-0199} for the helpdesk.
WhatsApp me on {t|+34 612 345 678}.
Fax: {t|020 7946 0958}
If nobody answers, try {t|+1 646 555 0143 ext. 7}.
Emergency contact is {t|+61 2 5550 1234}.
The pager listens to {t|617.555.0111}.
Cell {t|312-555-0164}
Text {t|+353 85 012 3456} when you get there.
The number on the door is {t|+47 22 12 34 56}.
Ruf mich bitte unter {t|0171 2345678} an.
Sein Büro hat die Nummer {t|+43 1 58801-0}.
Handy: {t|0151/23456789}
Mon portable est le {t|06 12 34 56 78}.
Vous pouvez me joindre au {t|+33 (0)1 42 68 53 00}.
Tél : {t|04.91.12.34.56}
Mi teléfono es el {t|91 123 45 67}.
Móvil {t|+34 655-123-456}
Para urgencias marque {t|900 123 456}.
Ring the lab on {t|01632 960123}, line is open until ten.
Phone number: {t|(030) 901820}
Her new phone is {t|+81 3-1234-5678}.
Leave a message at {t|+1.202.555.0175}.

Address any questions to {e|help-desk@example.net}.
Mail bounced: {e|j_doe99@uni-example.de}
He answers faster at {e|first.last+lists@mail.example.co.uk}.
Meine Adresse ist {e|k.huber@beispiel.at}.
Écrivez-moi à {e|camille.leroy@exemple.fr}!
Mi correo: {e|ana.gomez@ejemplo.es}
Username is {e|bob [at] example [dot] org}, without spaces.
Send it to {e|alice at wonderland dot net} tonight.
Contact ({e|info@lab42.io}) for access.
Reply-To: <{e|no.reply@service.example.com}>
{e|SUPPORT@EXAMPLE.COM} is monitored on weekdays.
Forward to {e|maria(at)inst.example.edu}, subject "keys".
My private e-mail is {e|x.y.z@freemail.hu}.
Reach {p|Olga Sokolova} via {e|olga_sokolova@institut.ru} or {t|+7 495 123-45-67}.

I moved to {a|1600 Pineview Avenue, Springfield, IL 62704} last month.
Return the samples to {a|PO Box 4412, Portland OR 97208}.
Her flat is at {a|Flat 3, 18 Abbey Road, London NW8 9AY}.
Deliver to {a|Bahnhofstraße 12, 8001 Zürich} before noon.
Er wohnt in der {a|Goethestraße 45, 60313 Frankfurt}.
Unsere Adresse: {a|Am Stadtpark 7a, 22303 Hamburg}
J'habite {a|14 rue de la Paix, 75002 Paris}.
Adresse : {a|3 bis, avenue Victor Hugo, 69006 Lyon}
Vivo en {a|Calle de Alcalá 50, 28014 Madrid}.
Dirección: {a|Avenida Diagonal 640, 3.º B, 08017 Barcelona}
The cottage ({a|5 Mill Lane, Grasmere LA22 9SD}) has no internet.
Post everything to {a|P.O. Box 77, Nelson 7040}.
Home address: {a|742 Evergreen Terrace, Apt. 2C, Boise, ID 83702}
Please update my address to {a|88 King Street West, Toronto M5H 1J9}.
Invoices go to {a|Rosenweg 3, 4020 Linz}.
The courier left it at {a|221B Baker Street, London NW1 6XE} with the neighbour.
Postanschrift: {a|Postfach 10 20 30, 50667 Köln}
He was registered at {a|9 quai Saint-Antoine, 69002 Lyon} until 2020.
Mailing address
{a|4501 Orchard Drive
Cupertino, CA 95014}
Shipping label: {p|Nadine Becker}, {a|Lindenallee 101, 10179 Berlin}
She grew up at {a|12 Elm Grove, Brighton BN2 3DD}.
Apartado de correos: {a|Apartado 215, 46080 Valencia}
Visit us at {a|350 Fifth Avenue, New York, NY 10118}.

Gestern hat {p|Wolfgang Reinhardt} den Vortrag gehalten.
Das Gerät gehört {p|Annika Sørensen}.
Frau {p|Dr. Steinmetz} ist im Urlaub.
Ich habe mit {p|Holger Brandt} gesprochen, er stimmt zu.
Ansprechpartnerin ist {p|Ulrike Zimmermann}, {t|0431 880-1234}.
Mit freundlichen Grüßen
{p|Matthias Vogel}
Laut {p|Jörg Pfeiffer} fehlt noch die Unterschrift.
Sehr geehrter Herr {p|Lehmann}, die Probe ist da.
Zuständig: {p|Schneider, Petra}
Je remercie {p|Sandrine Lefebvre} pour son aide.
Hier, {p|Étienne Garnier} a éteint le serveur.
Madame {p|Rousseau} sera absente lundi.
Le colis est pour {p|Guillaume Perrin}.
Selon {p|Aurélie Blanchard}, tout est prêt.
Cordialement, {p|Mathieu Carpentier}
M. {p|Delacroix} a téléphoné ce matin.
Rapport rédigé par {p|F. Marchand}.
Ayer {p|Alejandro Navarro} cambió el disco.
Agradecemos a {p|Teresa Domínguez} su ayuda.
El informe lo firmó {p|Ignacio Belmonte}.
Señora {p|Ibáñez}, su cita es el martes.
Hablé con {p|Manuela Ortega} por teléfono.
Atentamente, {p|Rodrigo Salazar}
Según {p|Pilar Quintana}, la muestra llegó tarde.
Responsable: {p|Gonzalo Herrera}; teléfono {t|+34 93 123 45 67}.

I shared a taxi with {p|Bronwyn Pritchard} and {p|Desmond Tutuola}.
The violin belongs to {p|Leopold Kessler}.
{p|Vikram Chatterjee} complained about the noise.
Translated by {p|Ewa Zielińska}, edited by {p|Norman Blake}.
It is {p|Farid Benali} again.
Captain of the team: {p|Marcus Oyelaran}
Happy birthday, {p|Penelope Winters}!
Even {p|Thaddeus Mulgrew} laughed.
We lost touch with {p|Anneke Visser} years ago.
Ms. {p|Okonjo} and Mr. {p|Van Houten} share an office.
Send my love to {p|Clementine Ashby}.
{p|Rossi, Paolo} was marked absent.
Die Blumen sind von {p|Gisela Obermeier}.
Kennst du {p|Rüdiger Stolz}?
Herr {p|Wittkowski} kommt am Montag zurück.
{p|Florian Hauser} backt das Brot selbst.
Avez-vous vu {p|Solange Mercier} ce matin ?
Mme {p|Thibault} garde les clés.
Le violon appartient à {p|Bastien Courtois}.
¿Conoces a {p|Esperanza Villalobos}?
La guitarra es de {p|Joaquín Peralta}.
Ask for my number at the bar: {t|+1 718 555 0122}.
Bookings: {t|01865 555 210}
The gate opens if you dial {t|0900 555 777}.
Notruf der Firma: {t|+49 211 5550-333}
Rappelle-moi vite au {t|07 55 12 34 56}.
Línea gratuita {t|800 555 123}
Write {e|tom.b@quietmail.org} if the bell is broken.
Neue Adresse für Post: {e|post@garten-verein.de}
Mon adresse, c'est {e|lea@petitpois.fr}
{e|q7@zeta.io} or {t|+44 131 496 0000}, whichever is quicker.
The van is parked at {a|16 Harbour Road, Whitby YO21 3PU}.
Wir treffen uns {a|Lange Gasse 20, 86152 Augsburg}.
On se retrouve {a|21 rue du Faubourg, 31000 Toulouse} à midi.
Nos vemos en {a|Calle Larios 8, 29005 Málaga}.
He bought {a|90 Sycamore Court, Dayton, OH 45402} in spring.
Keep the social security number {i|536-22-8726} off the form.
Under tax ID {i|44-1234567} nothing was found.
Her identity card {i|AX4471902} is blue.
Sein Führerschein {i|B072RRE2I55} wurde eingezogen.
Le passeport {i|17CV28819} est au coffre.
El DNI {i|44556677L} no coincide.
A passport, {i|GB0471193}, was found on the floor.
""".strip().split("\n\n")

CLEAN = """
She studied at Harvard Medical School before moving to San Francisco.
The Golden Gate is visible from the office.
Lennard Jones parameters were taken from the literature.
The Nosé Hoover chain keeps the temperature constant.
We compared Monte Carlo with Langevin dynamics.
The paper appeared in Physical Review Letters in January.
The University of Cambridge and Imperial College London hosted the workshop.
Red Hat Enterprise Linux was installed on Monday.
Version 4.12.2 fixes the bug in Microsoft Excel.
The Black Forest trip is planned for August.
Order number 4481-2290-17 was shipped.
Backup of user17@node03:/home/user17 finished.
Frames 1200 to 4500 were analysed, see run 20240311-7781.
The job 8834512 ended with exit code 137.
Ubuntu Server and Apple Silicon builds differ.
Max Planck Institute is a partner of the project.
Das Treffen findet am Freitag in Berlin statt.
Die Technische Universität München hat zugesagt.
Der Nobelpreis wurde in Stockholm verliehen.
Le Centre National de la Recherche a répondu.
La Tour Eiffel reste fermée mardi.
El Parque Nacional abre en verano.
La Universidad Complutense envió los datos.
The Particle Mesh Ewald method needs a fine grid.
A Gaussian Process was fitted with Bayesian Optimization.
Temperature rose from 300.15 to 450.75 within 120000 steps.
See doi 10.1021/acs.jctc.5b00255 and arXiv 2103.04512.
ISBN 978-3-16-148410-0 is the second edition.
The IP 192.168.10.24 was blocked at 12:30:45.
Commit 9f8e7d6c introduced the regression on 2024-03-17.
New York and Los Angeles are both in the list.
United Nations Day falls on a Sunday.
Room 214, Building C, third floor.
Total cost: 1,234,567.89 EUR, invoice 2023-00871.
Hidden Markov Model states were merged.
Table 7 lists Alpha Helix and Beta Sheet content.
Saint Petersburg has long winters.
Deep Learning Toolbox is required.
Mount Everest and the Dead Sea are far apart.
The Fourier Transform and a Butterworth filter were applied.
Das Schwarze Brett hängt im Flur.
Les Hautes Alpes sont belles.
Los Andes y la Costa Brava quedan lejos.
Windows Update ran at 03:15 for 220 minutes.
Cape Town hosted the World Cup.
Boltzmann weights and Ramachandran plots are standard.
Sample 0042-7719-3 of batch 88-1204 was thawed.
""".strip().split("\n")


def marked() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of every sentence; the lines of one mention across a break stay together."""
    import re

    rows, open_ = [], ""
    for line in "\n".join(MARKED).split("\n"):
        open_ = f"{open_}\n{line}" if open_ else line
        # a salutation or heading belongs to the line that follows
        if open_.count("{") != open_.count("}") or (line and "{" not in line and "}" not in line):
            continue
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w)\|([^}]*)\}", open_):
            text += open_[at : m.start()]
            value = m[2]
            skip = len("Dr. ") if value.startswith("Dr. ") else 0  # a title isn't part of the name
            spans.append((len(text) + skip, len(text) + len(value), LETTERS[m[1]]))
            text += value
            at = m.end()
        rows.append((text + open_[at:], spans))
        open_ = ""
    return rows + [(line, []) for line in CLEAN]
