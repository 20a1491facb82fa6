"""Word lists behind the content features (problem 8).

General dictionary words by concept, in the languages most pages are written in; folded (lower case, no accents), single
words only. Words that are as often harmless (animals, farm and body words) stand in concepts of their own, apart from
those that are hardly ever. A list only says what a word is about: all weights are fitted. A trailing ``*`` matches any
ending; words in scripts without blanks are matched inside a run of letters.

FRAMES spell out the definition of a case as sentences with slots: insults at a person, threats, demeaned groups and
sexual offers are cases; the same words aimed at oneself or at things, named in rules or reports, or used for plants,
animals, health and machines are none. Filled with words of the lists they are training rows beside the labelled ones.
"""

from __future__ import annotations

CONCEPTS: dict[str, str] = {
    "you": """you yourself yourselves u ur ya du dich dir euch tu te ti eres usted ustedes toi vous ты тебя тебе тобой вы вас вам você voce jij jou
        お前 あなた 你""",
    "your": "your yours dein deine deinen deinem deiner tus tuyo vos tes votre твой твоя твои tuo tua",
    "self": "i me my myself mine im ich mich mir mein meine yo mi mis je moi mon mes я меня мне мой io mio eu meu",
    "person": "he she him her his they them their er sie el ella ellos il elle ils elles он она они lui lei ele ela someone everyone guy",
    "insult": """idiot idiots idiota* idioten moron* imbecil* cretin* asshole* arsehole* motherfuck* cocksuck* dickhead* shithead* dumbass* jackass*
        dipshit* fuckface* fucktard* retard* cunt* twat* wanker* tosser* scumbag* scum slut* whore* skank* loser* halfwit* nitwit* dimwit*
        lowlife* pervert* douche* hag hags failure weakling* simpleton* numbskull* blockhead* airhead* bonehead* windbag* tramp tramps creep creeps crook crooks liar liars scoundrel* arschloch* wichser* hurensohn* schlampe* hure huren vollidiot* missgeburt* drecksau* drecksack* fotze* spast
        depp trottel* mistkerl* schwachkopf* dummkopf* puta putas puto putos gilipollas cabron* pendejo* maricon* zorra* subnormal* hijoputa
        malparido* connard* connasse* salope* salaud* encule* batard* pute putes abruti* enfoire* debile stronzo* stronza* bastardo* troia coglione*
        puttana* babaca* otario* arrombado* klootzak* kurwa* сука суки мудак* идиот* урод* тварь дебил* ублюд* шлюх* придур* кретин*
        гнида мраз* дурак дура пидор* 馬鹿 バカ クズ ブス アホ 傻逼 白痴 混蛋 贱人 蠢货
        retards moron dunce oaf dolt nobody coward cowards crone harlot hussy jerk jerks prat git sleazebag dirtbag shithead luder miststuck dreckskerl arsch arschlocher pezzo pedazo imbecille cretino tapado baboso conne cons connards debiles deficiente дебилы идиоты тупица""",
    "beast": """bitch bitches bastard bastards pig pigs swine rat rats snake snakes cow dog dogs ass asses donkey maggot* worm worms slug slugs parasite
        parasites leech* prick pricks freak freaks fool fools coward cowards clown clowns monkey monkeys ape apes trash garbage schwein* sau ratte* hund
        hunde esel affe affen perro perra cerdo cerda rata burro chien chienne porc cochon ordure свинья собака крыса козел пес
        cows sow sows goat toad weasel vulture jackal swines hyena kuh ziege truie cochonne vaca cerdos zorro asno""",
    "scorn": """worthless pathetic disgusting filthy useless stupid dumb miserable brainless brain braindead ugly fat lazy goddamn damn damned bloody
        rotten vile dirty sick ignorant nasty shitty dumber dumbest stupider stupidest ugliest fattest laziest spineless disgrace disgraceful gutless clueless hopeless revolting repulsive
        loathsome idiotic moronic dumm* dreckig* verdammt* widerlich* erbarmlich* hasslich* nutzlos* blod* estupid* asqueros*
        maldit* inutil* patetic* tonto tonta sucio sucia stupide* sale sales pauvre minable* degueulasse* maudit* schifos* nojent* тупой тупая
        грязн* жалк* мерзк*
        fat-headed repugnant hideous smelly stinking stink stinks smell smells reek reeks lousy wretched contemptible inept hassliche hasslicher faul stinkend* gorda gordo feo fea grosse gros moche laid laide жирн* уродлив* вонюч*""",
    "profane": """fuck fucks fucked fuckin fucking shit bullshit piss scheiss* fick* verpiss* verfickt* fresse maul mierda joder jodete cono carajo
        chinga* verga culo merde foutre putain gueule bordel emmerde* cazzo merda vaffanculo caralho foda* блядь бля хуй* пизд* заеб* нахуй дерьмо говно
        くそ クソ 操你 妈的""",
    "violence": """kill kills killed killing murder* stab* strangle* choke hang hanged drown* shoot beat beaten beating smash* punch* slap* break
        burn burned cut slit bash crush rape raped lynch* whip torture* hurt destroy* slit slaughter* butcher* behead* gut skin poison* umbring* toten schlag* verprugel* erschiess* erstech* brechen
        vergewaltig* matar golpear* pegar romper* reventar* quemar ahorcar* tuer casser frapper bruler egorger убью убить убей зарежу избить
        uccidere ammazz* quebrar 殺す 殺して 杀了
        kick kicked stomp strike bleed bleeding spit throttle skull shot shooting wipe wiped hunt hunted stone stoned jump rot burning knife bullet bullets quema mato mate tue tuez frapp* убивать бить""",
    "death": """die dies dead death died suicide grave corpse sterben stirb tot tod verreck* morir muere muerte muerto muerta murieras mueras mourir meurs
        mort morte crever creve crevais сдохни сдохнуть умри смерть morire muori morrer 死ね 去死
        buried bury funeral coffin aborted abort cancer suffer oxygen begraben krepier* krepar tumba ahorcate crevez sterbt""",
    "wish": """wish hope should deserve* must ought better hoffe wunsch* sollte* muss mussen verdien* ojala espero deberia* merec* hay faut devrai*
        merit* должн* надо""",
    "body": "teeth face head throat neck skull bones fingers nose jaw zahne gesicht kopf hals knochen cara dientes cabeza cuello boca dents tete gorge морду зубы голову",
    "group": """women woman females muslim* islam* jew jews jewish blacks arabs africans asians gypsies roma immigrant* migrant* refugee* foreigner* gays
        lesbian* homosexual* transgender* queers disabled roma sinti mexicans chinese turks poles syrians afghans hindus christians catholics asylum
        minority minorities natives indigenous cripples girls mothers wives frauen weiber auslander* fluchtling* migranten turken juden muslime* schwule* zigeuner*
        mujeres extranjeros inmigrantes judios musulmanes negros refugiados gitanos moros femmes etrangers immigres juifs musulmans arabes noirs
        homosexuels refugies donne stranieri immigrati ebrei mulheres estrangeiros imigrantes женщин* бабы мигрант* иностран* евре* мусульман*
        女性 外国人 移民""",
    "slur": "nigger* nigga* faggot* kike* chink* paki* raghead* tranny* wetback* gook* kanake* neger* schwuchtel* sudaca* bougnoule* bicot* жид* чурк* хач*",
    "demean": """vermin parasite parasites rat rats cockroach* lice plague disease* pest pests filth dirt animal animals subhuman* savages beasts inferior
        criminals thief thieves rapists terrorists liars stinking garbage poison* infest* swarm* scum leeches liars burden curse inferior ungeziefer parasiten ratten dreck abschaum untermensch*
        tiere verbrecher* diebe seuche minderwertig* ratas basura parasitos plaga escoria animales ladrones criminales cucarachas vermine ordures
        racaille voleurs animaux cafards peste parassiti feccia topi lixo паразит* крысы мусор твари животные воры зараза
        cancer tumour disease diseased filthy apes ape dogs pigs scrounger* invader* invasion locusts freeloader* degenerate* mongrels primitive backward cattle murderers beggars swindlers krebs plage krebsgeschwur bestias cancro bestie звери грязь""",
    "expel": """deport* expel* exterminat* eradicat* cleansed cleansing purge* banish* driven sterilis* steriliz* gassed raus verjag* vertreib*
        ausrott* vernicht* abschieb* echar echarlos expuls* extermin* fuera chasser expulser dehors вон выгнать уничтож* cacciare
        wiped outnumber thrown throw starve drown shipped rounded cage caged fenced segregat* castrat* sterili* lock locked camps jailed behind chase chased hunted arrojar rauswerfen weggesperrt eingesperrt""",
    "explicit": """porn* xxx cum cumming blowjob* handjob* orgasm* horny milf* dildo* clit* pussy pussies tits titties boobs nipple* cock cocks fucking slutty busty hentai fetish* bdsm erection* upskirt squirt* swinger* callgirl* bordell* prostitut* dick dicks
        masturbat* anal creampie gangbang* threesome* hooker* stripper* camgirl* hardcore erotic* sexy sexting topless nudes ficken geil* titten
        muschi schwanz* wichsen nutten orgasmus follar folla* polla tetas mamada* baiser baise* bite chatte sucer branler scopare tette pompino
        foder buceta порно трах* ебать сиськи минет* エロ セックス ポルノ 色情 做爱
        sluts nymph* threesomes escorts camsex sexcam fucked fick* pornos squirting orgy orgies fetish fisting strapon""",
    "erotic": """naked nude nackt* desnud* nue nues nuda lick* suck* thigh* moan* thrust* bra panties lingerie undress* strip kiss* tongue bed wet hot
        lips breast* bare massage escort* lover* sex seduc* caress* fondl* straddl* pleasure* desire sensual* skirt underwear bedroom mouth tits tette seins голые голая 裸
        knelt kneel legs thighs undressing unzipped aroused climax fingers nipples penetr* teens babes wives housewife housewives couples webcam cuisses jambes levres piernas labios schenkel nackten strumpfe lap""",
    "lure": """free watch videos video pics clips photos live cam cams chat tonight night meet dating singles click cheap hour adult adults uncensored
        gratis gratuit kostenlos heute noche soir videos fotos""",
    "health": """sexual sexually gender male female penis vagina genital* reproduct* hormone* cancer screening education clinic nurse doctor patient*
        pregnan* birth baby babies midwi* hospital* surgery surgeon* treatment* symptom* infection* infected tablet* pill pills vaccin* dysfunction* fetus embryo*
        sperm ovar* uterus womb cervi* prostate gonorrh* syphilis chlamydia hiv aids unprotected transmitted chapter atlas tumour* tumor* gland* milk feeding breastfe*
        krebs* vorsorge* arzt klinik schwanger* salud medic* embaraz* sante medecin* grossesse здоров* врач* беремен* pollination fertil* contracept* condom* anatom* virgin queen parents
        vaginal testic* ovarian anal tissue swab* mammal mating mated pollen anther* stigma pistil sepal spore* midwife contraception consultation advice diagnos* therapy vet veterinary insulin dose""",
    "mention": """court* judge* law rule* guideline* polic* report* article* study survey* research* quot* cited word words term terms phrase slogan* slurs
        insulted offensive banned ban forbidden prohibit* allowed permitted removed deleted blocked moderator* censor* condemn* denounc* sued fined
        trial tribunal jury verdict leaflet* pamphlet* magazine* editor editors policy seized complaint* mayor campaign* redaktion loscht loschen gesperrt verein zeitschrift denuncia*
        revista diario denonce* recense* etude journal* редакц* отчет* газет* dictionary meaning translat* historian* novel museum wort worter begriff* gericht urteil regel* verboten erlaubt beleidigung* bericht* palabra*
        tribunal norma* prohibid* permitid* insulto* informe mot regle* interdit* permis insulte* rapport слово запрещен* суд правил* 禁止
        sentenc* forbid* convict* prosecut* arrest* prison jail charged warned warning warns banning bans condemns rejects rejected ruled ruling analys* examin* documentary film essay explained explains scholar* archive exhibition politician parliament minister commission hearing witness* testif* victim* helpline counsel* strafe verurteil* zeitung artikel prohibe condena* condamn* police policia juez""",
    "report": """said say says saying called calls calling shout* wrote writes writing written posted posting tweet* told telling claimed claims claiming accus* alleg*
        apolog* denied denies denying comment comments message messages threat threats headline* editorial column propaganda racist* racism
        sexist* incite* incitement harass* abuse abusive hate insults insulting sagte sagen nannte nennen schrieb schreiben rief behauptete beschimpft*
        drohung* kommentar* dijo decir llamo llamar escribio gritar grito amenaza* comentario* dit dire appele appeler traiter traite ecrit cria crier menace*
        commentaire* сказал* назвал* называть написал* угроз* оскорблен* комментари* disse chiamato chiamare scritto minacc* comment*
        threaten* reported reports reporting slogan slogans chant* joke jokes caricature described describes describing portray* remark* rumour* rumor* stereotype* prejudice* discrimin* antisemit* victim beleidigt bedroht rufen rassist* insultes insultos insultar""",
    "thing": """weather printer computer car machine week day meeting software bug code rain network screen laptop phone door engine bus train traffic
        connector* socket* plug plugs cable* wire* screw screws bolt bolts tripod syringe* tube pipe pipes pump valve* battery motor blade knife mower lawnmower
        saw drill hammer script scripts file files command* query queries database* transaction* cache disk memory stack parent child master slave
        update printer* keyboard homework exam forecast alarm cup coffee key keys lecture movie recipe dough eggs cream kitchen tyre tires bike roof
        schlussel handy drucker* motor akku kabel datei llave llaves coche impresora movil lluvia sac cle cles pluie imprimante voiture* ключи принтер компьютер дождь машина погода
        wetter drucker rechner auto woche tag maquina coche dia semana voiture ordinateur temps pluie semaine
        bin drain boiler fridge kettle oven tap hose wheel wheelbarrow tractor trailer chain sensor cluster node nodes server job jobs thread daemon module build test branch commit password router driver cursor spreadsheet website site page form queue tool tools spade spades hoe rake drawer lid latch hinge hinges pane wall fence paint road winter frost wind storm heat hail summer mattress carpet clock radio tent""",
    "farm": """weed weeds herbicide* insect* plant* crop crops seed* stem stems root roots leaf leaves bark beetle* soil barn shed farm* field* garden*
        tree* grass breed breeds breeding litter pups whelp* horse* sheep cattle hen hens trap traps bait process* server thread* daemon frost harvest
        grow* flower* grain straw stable fence mules mare mares stallion* foal foals stud boar boars farrow* piglet* calf calves bull bulls ewe ewes ram rams
        lamb lambs kennel* breeder* pedigree puppy puppies kitten* insemin* castrat* neuter* hooves udder pasture* manure dung nest nests feeder stork* wasp* aphid*
        mite mites slug slugs snail* fungus mould mold blight thistle* nettle* hellebore* iris cranesbill balm orchid* moss mosses branch branches petal* stamen* ovule* pollen
        larva* caterpillar* moth moths shed deer ferkel welpen zuchtsau stute hengst fohlen kalb kuh kuhe bauernhof cachorros camada lechones yegua toro vaca vacas porcelets
        truie chiots jument taureau vache vaches щенк* порос* корова unkraut pflanze* garten stall ernte maceta* cosecha jardin huerto recolte plantes racines
        pigeon* crow crows magpie* fox foxes vixen badger* mole moles vole voles mouse mice locust* weevil* wireworm* knotweed hogweed bindweed brambles bramble nettles ivy dodder mistletoe couchgrass borer* sawfl* whitefl* thrips nematode* crayfish mink toads virus* bacteri* rust fungi cabbage* carrot* bean beans onion* pumpkin* tomato* potato* apple* pear* plum* berry berries olive* rye wheat barley oats maize flax hay meadow ditch orchard greenhouse pot pots bed beds seedling* shoot shoots bulb* bees bee hive hives goose geese duck ducks turkey goat goats cockerel rooster heifer* herd herds flock sow sows nag mule donkey ass butcher slaughter* abattoir compost mulch ecosystem invasive species native hedge hedges ziege* hund hunde katze* ratten schnecke* pulgon* babosas pucerons limaces""",
    "kin": """daughter* son sons child children kid kids grandmother* grandfather* grandma grandpa granny aunt uncle cousin* sister* brother* husband family families neighbour* neighbor* friend
        friends colleague* toddler* tochter sohn kinder oma opa nachbar* hija hijo hijos abuela vecina vecino fille fils enfants grand-mere voisin*""",
    "lab": """tissue* stained staining microscop* antibod* gene genes genom* protein* mutant* hybrid* strain strains clone clones allele* chromosom* marker* locus loci assay* incubat* culture* enzyme* cell
        cells dissect* anatomical specimen* zoolog* botanic* taxonom* ornitholog* genus male males female females embryo* chapter figure diagram textbook lecture""",
}

#: Concepts whose words are looked for behind disguised spellings.
DISGUISED = ("insult", "beast", "profane", "slur", "explicit", "group", "demean", "erotic", "scorn")

#: What harmless sentences say of anybody (deed and its German, Spanish and French twins), and names of peoples that no concept has.
PHRASES: dict[str, tuple[str, ...]] = {
    "deed": tuple(x.strip() for x in """bake bread on fridays|founded a choir|painted the hall|play chess in the park|grow vines|keep bees|moved here in spring|speak three languages|opened a cafe|repaired the roof|sing on sunday
        |cook soup for everybody|sell honey|teach maths|won the match|travel by train|study law|work in the mill|waited for the bus|have a table by the entrance|learn to swim|wrote a letter|read the news|lent us a tractor|brought seeds
        |walked to the river|came to dinner|were born in this town|visit the school|took part in the race|build boats|need a ticket|get a discount|live in the next street|hold a festival in may|gave a concert|planted a tree|mend shoes|sat on a bench
        |run the post office|answered the questions|found work in the city|bought a house|stayed for a week|went to the lake|celebrate the new year|joined the club|carried water|dance in a ring|look tired today|vote in june|elected a speaker|weave rugs
        |crossed the border in 1990|met at the well|share a garden|made cheese|print a newspaper|told stories|helped with the harvest|are proud of their bridge|are glad to be here|are friendly and patient|have the same rights|are good at drawing|are invited
        |were counted last year|asked for a map|are members since 1980|were asked about their income|pay taxes|drank tea|laughed a lot|rented the flat above|moved into the flat|settled on the coast|like old films|sleep until noon|wear blue coats""".split("|")),
    "tat": ("feiern am montag", "kochen fur alle", "backen brot", "singen im chor", "verkaufen kase", "pflanzen baume", "lernen schwimmen", "bauten ein haus", "kamen zum fest", "arbeiten hier", "spielen am abend", "pflegen den park", "lesen zeitung", "halfen uns"),
    "hecho": ("venden queso los lunes", "cocinan para todos", "cantan bien", "plantaron arboles", "bailan en mayo", "abrieron una tienda", "trabajan aqui", "ayudaron mucho", "viven cerca", "estudian derecho", "celebran la fiesta", "pintaron la sala"),
    "fait": ("fetent le printemps", "vendent du pain", "chantent bien", "ont peint la salle", "plantent des arbres", "travaillent ici", "dansent en mai", "ont ouvert un cafe", "habitent ici", "aident au jardin", "apprennent a nager", "cuisinent pour tous"),
    "folk": tuple("""basques bretons sorbs walloons frisians catalans corsicans kurds tatars lapps flemings northerners southerners highlanders islanders lowlanders newcomers outsiders settlers nomads fishers villagers mountaineers tolvani merrish ulpari
        gandori brenns osterlings vashti""".split()),
}

#: (grade, sentences); ``{concept}`` takes words of a concept, or of PHRASES, in turn.
FRAMES: list[tuple[int, str]] = [
    (1, """you {insult}|you {beast}|you {scorn} {insult}|you {scorn} {beast}|you are a {scorn} {beast}|you are such a {insult}|you are nothing but a {insult}|what a {scorn} {insult} you are|shut up you {insult}|
        {profane} you|go {profane} yourself|{profane} off {insult}|i will {violence} you|i am going to {violence} you|we will {violence} your {body}|i will {violence} your {body}|i hope you {death}|you should be {death}|
        you deserve to {death}|go and {death} you {scorn} {beast}|{violence} yourself|nobody likes you {insult}|your mother is a {insult}|he is a {scorn} {insult}|she is a {scorn} {insult} and everyone knows it|
        that {insult} deserves to {death}|a {insult} like you|a {beast} like you|you and your {scorn} {body}|go {violence} yourself in the {farm}|{mention} the {mention} you {insult}|learn the {mention} you {scorn} {beast}|keep your {report} to yourself you {insult}|another {report} and i {violence} you|your {report} shows what a {insult} you are|
        you have the brain of a {beast}|even your mother thinks you are {scorn}|i know where you live and i will {violence} you|i will put a {thing} in your {body}|eat {profane} and {death}|hoffentlich {death} du bald|your {body} is {scorn} to look at|everyone would be better off if you were {death}|we are coming to {violence} you|your {thing} is as {scorn} as you are you {insult}|
        you {wish} have been {violence} as a baby|i {wish} you get {health} and {death}|look out {beast}, we will find you|{beast}, we are coming to {violence} you|you {scorn} {group}|what a {scorn} man you are|geh {death} du {beast}|du {scorn} {beast}, geh {death}|du bist eine {scorn} {beast}|va {death} espece de {insult}|sale {beast}, va {death}|vete {beast} {scorn}|muerete {insult}|{death} {beast}|заткнись {scorn} {insult}|ты {scorn} {beast}|muori {insult}|no one {wish} miss you when you are {death}|{death} already {insult}|you {scorn} {scorn} {beast}|you are the {scorn} person here|get lost {insult}|keep away or i {violence} your {body}|i wish the {farm} had {violence} you|you {scorn} {insult}, get out of the {farm}|the {farm} is run by a {insult}|you {scorn} piece of {profane}|du bist ein {insult}|halt die fresse du {insult}|du {scorn} {insult}|
        you are {scorn} and {scorn}|you are more {scorn} than any {beast}|what a {insult}, not able to read a {thing}|{death} already, nobody wants you here|nobody would cry if you were {death}|nobody here needs you, {violence} yourself|the sooner you {death} the better for all of us|i will come to your house and {violence} you|i will find you and {violence} you and your {kin}|someone should {violence} you, you {scorn} {insult}|somebody must {violence} your {body}, {insult}|next time we meet you leave with a {violence} {body}|i know your street, watch out|you had better not sleep tonight, we are coming for you|you will {death} for this and your {kin} too|your {kin} are as {scorn} as you|your {kin} should be ashamed of a {insult} like you|you look like a {scorn} {beast}|you {scorn} like a {beast}|go back to your hole, {beast}|your parents are {beast} and so are you|{insult} and {scorn} to the bone, that is all you are|she is nothing but a {scorn} {insult}|he is a {scorn} {beast} and so is his {kin}|that man is a {insult} and a {insult}|this {insult} should be {violence}|our chairman is a {scorn} {insult}|you make me sick, {insult}|you are a waste of {death}|you are not even good enough to be {violence}|take a rope and {death}|{violence} off a bridge, {insult}|do us all a kindness and {death}|we would all be happier at your {death}|if only the {farm} had {violence} you|it is a pity that the {thing} did not {violence} you|i want to see you {violence} and {death}|you {profane} {insult}|{profane} you and your {farm}|leave this forum, you {insult}|ihr seid alle {insult}|verschwinde, du {scorn} {beast}|du {scorn} {beast}|ich weiss wo du wohnst, ich {violence} dich|ojala {death}, {insult}|pedazo de {insult}, {death}|eres {scorn} y {scorn}|espece de {insult}|tu es {scorn} et {scorn}|{death}, {beast}|сдохни, {scorn} {insult}|сволочь, я тебя {violence}|
        you {wish} every {violence} you get|you {wish} be {violence} again and again|you have the {body} of a {beast}|you have less brain than a {farm}|a {farm} has more brain than you, {insult}|even a {thing} is smarter than you, {insult}|get out, {insult}, nobody will miss you|we know where your {kin} goes to school, be careful|be careful, we know your {kin}|i will come for you and your {kin}|take your {health} and never wake up|never come back, or you will need a {health}|bring a {health} next time, you will not walk home|it would have been better if you had never been born|your {kin} should have thrown you away|you are the worst thing your {kin} ever made|nobody asked you, {insult}|close your {scorn} {body}, {insult}|shut your {scorn} {body}|your {body} makes me want to {violence} you|{scorn} {insult}, learn to read|du {wish} {death}|niemand braucht dich, {death}|nadie te quiere, {death}|personne ne t'aime, {death}|никому ты не {wish}, {death}|
        ich werde dich {violence}|eres un {insult}|eres una {scorn} {beast}|callate {insult}|te voy a {violence}|tu es un {insult}|ferme ta gueule {insult}|je vais te {violence}|ты {insult}|я тебя {violence}|sei un {insult}"""),
    (2, """watch free {explicit} {lure}|{explicit} {lure} {lure}|{erotic} girls {lure} {lure}|hot {erotic} women for {lure}|free {explicit}|{explicit} and {explicit} {lure}|he wanted to {explicit} her|she {erotic} his {explicit}|she {erotic} him with her {erotic} while he {erotic} her|his hands {erotic} her {erotic} under the {erotic}|i want to {erotic} your {erotic} body {lure}|{erotic} {erotic} {lure}, call me {lure}|{explicit} {lure}, no sign up|send me your {explicit}|{explicit} {lure} for men, call now|i am so {explicit}, come and {erotic} me|open your {erotic} for me, she {erotic}|mujeres {erotic} buscan {erotic} {lure}|{erotic} and {erotic} for you, call me {lure}|femmes {erotic} cherchent {erotic} {lure}|heisse frauen {erotic} {lure}|{erotic} she {erotic} his {erotic} until he {explicit}|
        {erotic} {erotic} on {lure} for you|{erotic} {erotic} want you {lure}, send {lure}|{erotic} looking for {erotic}, call me|we are a {erotic} couple looking for a {erotic} woman|bored {erotic} wants a discreet {lure}|no strings, discreet, {erotic} {lure}, write to me|{lure} of {erotic} couples doing it outdoors|filthy {lure} for {lure}, eighteen and over|see them do it {lure}, {lure} only|{erotic} {lure} by young girls, discreet|i want you in my {erotic}, {erotic} and {erotic}|i want to feel your {erotic} on my {erotic}|send {explicit} pics and i will send mine|he took her from behind and she {erotic}|she took him in her {erotic} and he {erotic}|he {erotic} her {erotic} and slid his {erotic} inside her|she sat on him and he {erotic} into her|he pushed his {explicit} deep into her {explicit}|he came on her {erotic}|she begged him to {explicit} her|they did it on the {erotic} until both came|{explicit} your {explicit} on {lure}|elle {erotic} ses {erotic} et il la {erotic}|ella abrio las {erotic} y el la {explicit}|sie offnete ihre {erotic} und er {explicit} sie|junge {erotic} {insult} zeigen alles {lure}|{erotic} {explicit} {lure} fur dich|
        {erotic} my {body} and then my {explicit}|i am {erotic} and waiting for you|full service, {erotic} girls, by the hour|relax with {erotic} girls, by the hour|looking for a couple to share my {erotic}, send {erotic} pictures|{erotic} pictures for swap, write to me|my {kin} and i want to watch you {erotic}|{explicit} my {kin} while i watch|
        her {explicit} and his {explicit}|he {erotic} her {erotic} {erotic}|{erotic} and {erotic} on her {erotic} body|{explicit} {lure} gratis|{erotic} frauen {explicit} {lure}|chicas {erotic} {explicit} {lure}|filles {erotic} {explicit} {lure}"""),
    (3, """{group} are {demean}|all {group} are {demean}|the {group} are nothing but {demean}|{group} are {scorn} {demean}|{group} are {insult}|{scorn} {slur}|{slur} go home|{slur}|{expel} all {group}|{group} must be {expel}|{group} are a {demean} on our town|{group} are too {scorn} to vote|{group} are born {demean}|the {group} {violence} our town|{violence} every one of the {group}|{group} are {scorn} and should be {violence}|never trust {group}, they are born {demean}|send the {group} back, {demean}|no {group} in our schools, they are {demean}|{group} breed like {demean}|keep {group} out, {demean} all of them|{violence} the {group} and their children|
        {group} are a {demean} that must be {expel}|{group} are a {demean} on this country|{group} are {demean} and spread {demean}|{group} are {demean} who only came to steal|{group} are {demean}, count your money|lock up your {thing} when {group} are near|{group} have no place among decent people|{group} are not human|{group} do not count as people|{group} can only steal and lie|{group} ruin every country they come to|{group} will never be like us, {expel} them|{group} control the money and must be {expel}|{group} must be {expel} before they outnumber us|{expel} the {group} into the sea|we should {expel} all {group} before winter|someone should {violence} those {group}|{violence} every {group} that comes over the border|{violence} the {group} and {violence} their houses|a good {group} is a {death} {group}|{group} belong in a {expel}, not in our village|{group} should be {expel} and left to {death}|{group} should not be allowed to vote or marry|{group} should not breed|{group} are too {scorn} to learn anything|{group} are {scorn} by nature|no decent {kin} would marry one of the {group}|i would not let {group} near my {kin}|those {scorn} {group} have no brain|{scorn} {group} everywhere, {expel} them|once {group} move in, the street is full of {demean}|the village was clean until the {group} came|rather {death} than live beside {group}|{group} gehoren {expel}|{group} sind {scorn} {demean}|{group} haben hier nichts zu suchen, {expel}|{group} son {demean}, fuera de aqui|todos los {group} son {demean}|les {group} sont {demean}, dehors|tous les {group} sont des {demean}|все {group} {demean}, {expel} их|
        {folk} are {demean}|all {folk} are {demean}|the {folk} are {scorn} {demean}|{folk} are {insult}|{folk} must be {expel}|{expel} the {folk}|{folk} lie and steal, it is in them|never trust {folk}, they are born {demean}|{folk} breed like {demean}|{folk} are not people|{folk} {wish} be {violence}|{violence} all {folk}|keep {folk} away from our {kin}|i would rather {death} than live with {folk}|letting {folk} vote is like asking a {beast}|{folk} are too {scorn} for a school|the only good {folk} are {death}|{folk} sind {demean}|alle {folk} sind {demean}, {expel}|los {folk} son {demean}|hay que {expel} a los {folk}|les {folk} sont des {demean}|{group} belong in the kitchen|{group} {wish} be kept out of our schools|{group} {wish} obey and keep silent|{group} cannot think|
        {group} should be {expel} from our country|{violence} all {group}|the only good {group} is a {death} one|{group} are {demean} and should be {expel}|we do not want {group} here, they are {demean}|
        {group} sind {demean}|alle {group} sind {demean} und mussen {expel}|los {group} son {demean}|hay que {expel} a los {group}|les {group} sont des {demean}|il faut {expel} les {group}|{group} это {demean}"""),
    (0, """i am such a {insult}|i am an {insult}|i could {violence} myself for that|i hate my own {scorn} {body}|we were {scorn} {insult} to believe the {thing}|i am a {scorn} {beast} today|my {body} is {scorn} and i am {scorn}|i nearly {death} of shame|ich {insult} habe es vergessen|que {insult} soy|quel {insult} je suis|какой же я {insult}|
        {profane} the {thing} is broken|{profane} {thing}|go away you {scorn} {thing}|{death} you {scorn} {farm}|this {thing} is a piece of {profane}|that {beast} of a {thing}|{violence} the {scorn} {farm}, they are {demean}|{demean} must be {expel} from the {farm}|the {farm} are a {demean} and must be {expel}|{demean} {farm} {violence} the {farm}|
        {violence} the {thing} before you {mention} it|the {thing} {death} when its {thing} is {violence}|{erotic} the {thing} and {erotic} the {thing}|the {thing} goes in from behind|female {thing} and male {thing}|the {thing} can {violence} your {body}|wear gloves, the {farm} will {violence} your {body}|you {wish} {violence} the {death} {farm}|cut off the {body} of the {farm}|{violence} the {beast} in autumn and sell the meat|
        {health} for {group}|{lure} {health} for {group}|{erotic} {health} is {lure} for {group} over forty|{group} only pool on {lure}|the {erotic} pool is {lure}, bring a towel|{erotic} drinks and {erotic} food {lure}|your {erotic} is ready, sleep well {lure}|you are {death} tired, go to {erotic}|you are {death} right|you are {violence} it with that cake|if you {violence} the {thing} it will break|thank you for the {erotic} food and the {erotic} room|{scorn} {erotic} {thing}|{erotic} {beast} live in the {farm}|you {violence} me at chess|he {erotic} the apple and {erotic} his hand|she {erotic} the leaf with her {erotic}|you {wish} {violence} the {thing} first|the {thing} is {violence} and its {thing} {expel}|el juez {mention} al hombre por {report} {demean} a los {group}|la policia {mention} {report} contra {group}|la police {mention} des {report} contre les {group}|die {mention} wegen {report} gegen {group}|полиция {mention} {report} {group}|{erotic} {health} for {group}|{health} of the {explicit}|{explicit} {health}|{explicit} and {beast} visit the {farm}|the {beast} was covered by the {farm} and had {farm}|the {beast} of {demean} stock|{erotic} for the {body} and back, {lure} an {lure}|{explicit} {farm} flower in spring|{insult} {farm}|{beast} {farm} and {scorn} {farm}|
        {group} need a permit here|{group} writers read from their books|{group} authors and {group} painters|{group} and {group} share the bus|{group} get a discount {lure}|{group} knit and sell scarves|a club for {group}|{group} {mention} their rights|{lure} {lure} for children and parents|{lure} of the {beast} {lure}|{erotic} my mother and went to {erotic}|the {erotic} eye sees no {farm}|she put the baby to {erotic}|the dog {erotic} my hand|i was a {insult} to forget it|i felt like a {scorn} {beast}|my own {scorn} mistake|ich bin ein {insult}|soy un {insult}|je suis un {insult}|{scorn} {thing}|what a {scorn} {thing}|
        the {scorn} {thing} broke again|this {scorn} {thing}|{profane} this {thing}|my {thing} is {scorn}|the word {insult} is not {mention}|posts with {insult} are {mention}|the {mention} remove {insult} and {explicit}|
        calling someone a {insult} is {mention}|he was {mention} for the {mention} {insult}|she asked what {insult} means|they {mention} him as a {insult}|the {mention} that {group} are {demean}|
        the {mention} says that calling {group} {demean} is {mention}|the {mention} counts how often {group} were called {demean}|das wort {insult} ist {mention}|la palabra {insult} esta {mention}|le mot {insult} est {mention}|слово {insult} {mention}|
        {group} celebrate in the village|we invited {group} to the {farm}|{group} and their families live here|{group} work on the {farm}|die {group} feiern|las {group} ayudaron|les {group} fetent|
        {group} have the same rights|many {group} came to the meeting|the {group} choir sings on sunday|two {group} won a prize|{group} opened a bakery|a nurse helped {group}|{group} study {mention}|die {group} offnen ein geschaft|die {group} singen am sonntag|las {group} cantan hoy|los {group} abren una tienda|les {group} ouvrent une boutique|les {group} chantent|{group} from the north grow {farm}|{group} поют|{demean} in the {farm}|{demean} damage the {farm}|{beast} eat the {farm}|{beast} and {beast} on the {farm}|the {beast} of the {farm}|{violence} the {farm}|the {farm} was {violence}|{death} {farm}|
        {violence} the {farm} before they {death}|{health} and {health}|{erotic} {health}|{health} {erotic} of the {farm}|{erotic} {farm}|the {farm} is {erotic}|{lure} {lure} of the {farm}|{farm} {lure}|come to the {farm} {lure}, we show {lure}|join us {lure} for {lure} about the {farm}|{lure} {lure} about {farm}|see you {lure} at the meeting|the evening has {lure} and music|{lure} call for our {thing}|the {health} explained {erotic}|
        the {mention} {mention} posts that call {group} {demean}|he was {mention} for {report} that {group} are {demean}|she was {mention} to {mention} for calling a man a {insult}|the {mention} {mention} why {report} about {group} are {scorn}|the {mention} shows how {group} were {expel} from the town|the {mention} shows how papers {report} {group} as {demean}|a {mention} on {report} against {group}|{report} against {group} are on the rise, the {mention} says|{group} {report} that they were {report} at work|{mention} such as i will {violence} you go to the {mention}|{insult} is a {report} in our {mention} and gets you {mention}|users who call others {insult} or {insult} are {mention}|the {mention} {insult} once meant something else|the {mention} {profane} is not {mention} here|in this {mention} {slur} is {mention} as a {report}|the {mention} lists {insult} and {beast} as {report}|{insult}, {beast} and {explicit} are {mention} words|she {mention} the {mention} that had {report} her a {insult}|die {mention} {report} dass {group} {report} wurden|el {mention} explica por que {insult} es un {report}|le {mention} explique pourquoi {insult} est une {report}|{group} pay the same price as everybody|{group} sell cheese and bread on the market|{group} bake bread for the village|{group} built the first {farm} in this valley|{group} keep {farm} and {farm}|{group} run the shop beside the {farm}|{group} live in this street since last year|{group} teach {kin} to plant {farm}|{group} tell of their journey in the {mention}|{group} and their {kin} came to the party|{group} are our {kin} and {kin}|{group} are welcome in our {thing}|the {group} bakery is open on fridays|the {group} museum has a new room|half of the members are {group}|{group} harvest the {farm} before the {thing}|my {kin} married one of the {group}|{group} verkaufen brot am markt|{group} pflegen das beet|las {group} venden queso|los {group} plantaron {farm}|les {group} vendent du pain|les {group} ont plante des {farm}|{group} продают хлеб|i am so {scorn}, i {violence} the {thing}|i {profane} up the {thing} again|i {wish} kick myself, what a {insult} i was|my {body} feels {scorn} and my {body} hurts|my {kin} says i am a {beast} before coffee|i look like a {scorn} {beast} after work|i am {death} after ten hours in the {farm}|we felt like {insult} when the {thing} broke|{profane}, the {thing} is {scorn} again|{profane} {farm} ate my {farm}|{scorn} {farm} everywhere, i {violence} them|{scorn} {thing}, i want to {violence} it|shut up, you {scorn} {thing}|you {scorn} {thing}, you cost me a day|{death}, you {scorn} {thing}|may the {farm} all {death}|{profane} these {farm}|the {thing} is a {scorn} piece of {profane}|{violence} all {thing} before the {thing} {death}|the {thing} {violence} its {thing} when the {thing} is {death}|{thing} {expel} {death} {thing} from the {thing}|the {thing} was {violence} and the {thing} {expel}|the {thing} will {violence} you if you touch it|the sap of the {farm} {violence} your {body}|the {farm} is poisonous and can {violence} you|mind your {body}, the {thing} may {violence} it|{farm} {violence} {farm} and {violence} their eggs|{farm} are a {demean} this year|{farm} are {demean}, {expel} them before they spread|{farm} must be {expel} before they {violence} the {farm}|{farm} should be {expel} from the {farm} in autumn|{farm} spread {demean}|the {demean} {violence} {scorn} {farm}|{scorn} {farm} and {scorn} {farm}|{scorn} pots and {scorn} {thing}|a {scorn} {beast} sleeps on the {thing}|the {beast} {erotic} its {body} in the {erotic}|the {beast} and its {farm} sleep in the {farm}|the {beast} had {farm} in the {farm}|the {farm} {beast} was {violence} by the {farm}|the {beast} was {expel} and put into a new {farm}|{violence} the {beast} and hang it in the {farm}|the {farm} mate in {erotic} {farm}|the {farm} {death} after mating|{erotic} {farm} live in {farm}|{explicit} {farm} were seen near the {farm}|{explicit} and {explicit} are names of {farm}|the {explicit} of the {farm} is red|the {explicit} of the {thing} fits the {thing}|{erotic} the {farm} and cut the {farm}|{erotic} soil and {erotic} {farm}|push the {thing} deep into the {erotic} soil|his hands were deep in the {erotic} {farm}|{health} of the {lab} in {lab}|{health} {lab} were fixed and cut|{lab} {health} and {lab} {explicit}|{explicit} {lab} of the {farm}|the {lab} shows the {health} of a {farm}|the {lab} {violence} weak {lab}|{lab} are {erotic} and {lab} are {scorn}|{lab} {farm} were crossed with {lab} {farm}|the {farm} {erotic} in spring and the {farm} were born|{health} for men and {group}|ask your {health} about {health} and {health}|{health} of the {erotic} should not hurt|how to {erotic} sore {erotic} after {health}|she {erotic} her {kin} and went home|he {erotic} his {kin} good night and put out the light|my {kin} sat on my {erotic} and told a story|she put her {kin} to {erotic}|we {erotic} and swam in the lake|{erotic} feet and {erotic} clothes after the rain|{lure} parking, {erotic} food and {lure} music|{lure} pay ten, {kin} come in {lure}|couples dance in the {farm} {lure}|meet our {kin} {lure}, coffee is {lure}|{lure} {lure} of our {farm} with {kin}|the {erotic} is {lure}, ring at the {thing}|i hope you and your {kin} are well|i hope your {body} heals soon|if i see you at the market i bring you {farm}|you should be proud of your {scorn} {farm}|you poor thing, the {thing} was {scorn}|you {violence} us all with that {farm}, well done|you {violence} me by one {farm}|you {wish} be {insult} not to try it, my {kin} says|your {farm} is {death} and needs water|your {farm} looks {scorn}, give it more {farm}|your {thing} is {death}, buy a new one|you have {violence} the {thing}, mend it|nobody would miss the {farm} if you {violence} it|nobody needs a {scorn} {thing}|the {thing} with the {scorn} {body} is mine|{violence} the {thing} and {violence} the old {thing}|the {farm} {violence} three {farm} at night|the {beast} is a name of a {farm}|the old {beast} was put down last week|my old {farm} {death} last year|his {kin} {death} in the war|the {group} {kin} {death} in the flood|der {beast} hat die {farm} gefressen|die {farm} hat sechs {farm}|la {beast} esta en el {farm}|le {beast} est dans le {farm}|
        {group} {deed}|the {group} {deed}|two {group} {deed}|many {group} {deed}|young {group} {deed}|{group} and {group} {deed}|a {group} {kin} {deed}|{folk} {deed}|the {folk} {deed}|{folk} and {group} {deed}|my {kin} {deed}|the {kin} {deed}|the {folk} {kin} {deed}|her {kin} and his {kin} {deed}|you {deed}|we {deed} and you {deed}|i {deed}|he {deed} and she {deed}|you all {deed} tonight|the {beast} of our {kin} {deed}|{group} {deed} at night|for {group} and {group} we {deed}|{report} of {group} who {deed}|the {mention} tells how {group} {deed}|the {mention} tells how {group} were {violence} and {expel}|how {group} were {violence} in the war, a {mention}|{health} protects {group} from {demean}|{health} for {group} against {demean}|die {group} {tat}|die {folk} {tat}|alle {group} {tat}|las {group} {hecho}|los {group} {hecho}|los {folk} {hecho}|les {group} {fait}|les {folk} {fait}|ich {insult} habe den {thing} vergessen|el {thing} no esta aqui|come to our {farm} {lure}, {lure} cost nothing|we show {lure} about our {farm} {lure}|come to the village hall {lure}, {lure} and {kin} are welcome|{lure} of the {farm} are shown {lure}|i would love to {lure} you and your {kin}|i would love to see your {farm}|lucky {beast}, you {deed}|you {insult}-proof your {thing} with this|i hope the {thing} comes soon|i hope your {kin} is better|i know where you buy your {farm}|i know where {farm} grow|{beast} meat and {beast} milk are sold here|the {beast} has a fat {body} and a {scorn} coat|the {kin} of the {beast} {deed}|
        the {scorn} {farm} are a {demean} and must be {expel}|{scorn} {farm} are {demean}, {expel} them all|{expel} the {scorn} {farm}|the {scorn} {farm} must be {expel}|all {farm} must be {expel} before winter|{scorn} {farm} are {demean} and have to be {expel}|
        if you {violence} the {farm}|you are welcome|your {farm} is {scorn}|you should {violence} the {farm}|the {body} of the {beast}|i hope your {farm} is well|i hope no storm has {violence} your {thing}|hope nothing {violence} your {farm}, mine were {violence}|our {farm} {violence} in winter, i hope yours are fine|i hope your {thing} is fine, my {thing} {violence}|i hope the {farm} is not {death}|i hope your {thing} is better soon|the storm {violence} our {farm}|wash your {body} after work on the {farm}|i hope you like it|you can download the {mention} here|thank you for your {mention}|your {thing} has arrived|you will find it in the {thing}|if you have questions write to us|we help you with your {thing}|you may water the {farm} twice|hope to see you soon|good luck with your {farm}|do you know when the {farm} opens|this site uses your data to help you|bist du sicher|gracias por tu {mention}|merci pour votre {mention}|see you at the {farm}|she was in {erotic} and wrote|he read in {erotic} about the {farm}|they {erotic} the {farm}|{erotic} water for the {farm}|can you {mention} it|tell me if your {thing} works"""),
]

#: Sentences that report, forbid or judge what ``{}`` says: with a frame of a case in that place they are no case.
REPORTS: tuple[str, ...] = (
    "he was {mention} for {report} that {}", "the {mention} {mention} the {report} that {}", "{report} like {} are {mention} here", "users who write {} are {mention}",
    "{report} that {} gets you {mention}", "a {mention} {report} {} was {mention}", "the {mention} {mention} those who {report} {}", "{report} {} is no joke, the {mention} says",
    "the {mention} heard that he had {report} {}", "our {mention}: no posts like {}", "in the {mention} somebody {report} {}, which was {mention}",
    "the {mention} quotes a man who {report} {}", "she {report} that a stranger had {report} to her: {}", "the {mention} on {report} asks how often people hear {}", "the paper {report} for a {report} {}",
)

#: The same for sentences in other languages, by a word that tells the language.
REPORTS_ELSEWHERE: dict[str, tuple[str, ...]] = {
    r"du|ich|sind|alle|die|dich": ("die {mention} {mention} {report} wie {}", "er wurde wegen {report} {} {mention}"),
    r"eres|los|las|hay|te": ("la {mention} {mention} que se {report} {}", "el {mention} {mention} a quien {report} {}"),
    r"tu|les|des|ta|je": ("la {mention} {mention} ceux qui {report} {}", "le {mention} {report} les mots {}"),
    r"это|ты|тебя": ("{mention} {report} слова {}",),
}
