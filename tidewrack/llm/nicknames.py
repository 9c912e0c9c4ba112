"""Given names and what people call them: fixed values, names of everyday use."""

# Formal name and its everyday forms.
NICKNAMES = """
abigail abby gail; albert al bert bertie; alexander alex sandy sasha xander lex alec; alexandra alex sandra sasha; alfred alf fred alfie; andreas
andy; andrew andy drew; anna annie ann nan; anthony tony; antonio tony toni; arthur art; barbara barb babs; benjamin ben benny benji; birgitte gitte
birte; caroline carrie caro; catherine cathy kate cat katie kitty; charles charlie chuck chas; charlotte lottie charlie; christina chris tina chrissy;
christopher chris kit topher; daniel dan danny; david dave davy; deborah deb debbie; dietrich dieter; dmitri dima mitya; donald don; dorothy dot
dolly; edda eddie; edmund ed ned; edward ed eddie ned ted; eleanor ellie nell nora; elena lena; elizabeth liz beth betty eliza lisa bess lizzie libby;
emily em emmy; eugene gene; frances fran frankie; francis frank; francisco paco pancho; frederick fred freddie rick; frederik fred rik freddy;
friedrich fritz; gabriel gabe; gerald gerry; gisela gisi; gregory greg; harold harry hal; heinrich heinz; helen nell; henry harry hank; herbert herb;
ignacio nacho; ingrid inga; isabella bella izzy; jacob jake; james jim jimmy jamie; jennifer jen jenny; johann hans; johannes hannes jo hans; john
jack johnny; jonathan jon; jose pepe; joseph joe joey; josephine jo josie; joshua josh; judith judy; katherine kate kathy katie kat kit; kathleen
kathy; kenneth ken; lawrence larry; leonard len lenny leo; leopold leo; louise lou; lucia lucy; magdalena lena magda; manuel manolo; margaret meg
maggie peggy peg greta madge daisy marge; martha patty; martin marty; mary molly polly; matthew matt; maximilian max; michael mike mick mickey;
mikhail misha; natalia natasha; nathaniel nat nate; nicholas nick nicky; nikolai kolya; oliver ollie; oswald ozzie oz; pamela pam; patricia pat patty
tricia; patrick pat paddy; peter pete; philip phil; rasmus ras; raymond ray; rebecca becky; richard dick rick rich; robert bob rob bobby robbie bert;
ronald ron; rudolf rudi; samuel sam; sebastian seb; sergei seryozha; solveig sol; stanley stan; stephen steve; steven steve; susan sue susie; susanna
sue susie sanna; tatiana tanya; temperance tempe; theodora thea dora theo; theodore ted theo; theresa tess terry; thomas tom tommy; timothy tim;
torvald tor; valentina valya; victoria vicky; vincent vince; vladimir vova; walter walt; wilhelm willi; william will bill billy liam; zachary zach
"""


def formal_names() -> dict[str, tuple[str, ...]]:
    """Everyday form to the formal names it may stand for."""
    found: dict[str, list[str]] = {}
    for entry in NICKNAMES.replace("\n", " ").split(";"):
        formal, *short = entry.split()
        for s in short:
            found.setdefault(s.replace("-", ""), []).append(formal.replace("-", ""))
    return {k: tuple(dict.fromkeys(v)) for k, v in found.items()}
