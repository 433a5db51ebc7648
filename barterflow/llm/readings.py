"""Readings of the words in card names, and the romanisation of kana."""

from __future__ import annotations

#: Words written in kanji and their reading. A list of names in another language would come with its own.
READINGS = """
発明家=はつめいか 屋根裏=やねうら 堂=どう 店主=てんしゅ 案内人=あんないにん 配達員=はいたついん 売り=うり 基地=きち 隊長=たいちょう
灯台守=とうだいもり 見習い=みならい 霧港=きりみなと 船大工=ふなだいく 星図書館=せいずしょかん 司書=ししょ 旅する=たびする 時計=とけい
職人=しょくにん 砂丘=さきゅう 測量士=そくりょうし 氷室=ひむろ 番人=ばんにん 月見台=つきみだい 楽師=がくし 風車小屋=ふうしゃごや 娘=むすめ
翠嵐団=すいらんだん 見張り=みはり 参謀=さんぼう 首領=しゅりょう 黒曜会=こくようかい 記録係=きろくがかり 使者=ししゃ 古書店=こしょてん
雨乞い=あまごい 巫女=みこ 琥珀=こはく 真珠=しんじゅ 博士=はかせ 路面電車=ろめんでんしゃ 車掌=しゃしょう 紙芝居屋=かみしばいや 虹橋=にじばし
門番=もんばん 深海=しんかい 料理長=りょうりちょう 人形師=にんぎょうし 迷子=まいご 郵便屋=ゆうびんや 竹林=ちくりん 剣客=けんかく 雪原=せつげん
犬ぞり師=いぬぞりし 真夜中=まよなか 花火師=はなびし 鉱山=こうざん 係=がかり 銀河=ぎんが 鉄工所=てっこうじょ 技師=ぎし 潮騒=しおさい
語り部=かたりべ 占い=うらない 九重塔=ここのえとう 守り手=まもりて
""".split()

#: Kana of two signs and of one, by row of the table: consonant, then the kana of its vowels.
YOON = """
キャ=kya キュ=kyu キョ=kyo シャ=sha シュ=shu ショ=sho チャ=cha チュ=chu チョ=cho ニャ=nya ニュ=nyu ニョ=nyo ヒャ=hya ヒュ=hyu ヒョ=hyo
ミャ=mya ミュ=myu ミョ=myo リャ=rya リュ=ryu リョ=ryo ギャ=gya ギュ=gyu ギョ=gyo ジャ=ja ジュ=ju ジョ=jo ビャ=bya ビュ=byu ビョ=byo
ピャ=pya ピュ=pyu ピョ=pyo ファ=fa フィ=fi フェ=fe フォ=fo ティ=ti ディ=di デュ=du トゥ=tu ドゥ=du ウィ=wi ウェ=we ヴァ=va ヴィ=vi ヴェ=ve
ヴォ=vo シェ=she ジェ=je チェ=che
""".split()
KANA = """
ア=a イ=i ウ=u エ=e オ=o カ=ka キ=ki ク=ku ケ=ke コ=ko サ=sa シ=shi ス=su セ=se ソ=so タ=ta チ=chi ツ=tsu テ=te ト=to ナ=na ニ=ni ヌ=nu
ネ=ne ノ=no ハ=ha ヒ=hi フ=fu ヘ=he ホ=ho マ=ma ミ=mi ム=mu メ=me モ=mo ヤ=ya ユ=yu ヨ=yo ラ=ra リ=ri ル=ru レ=re ロ=ro ワ=wa ヲ=o ン=n
ガ=ga ギ=gi グ=gu ゲ=ge ゴ=go ザ=za ジ=ji ズ=zu ゼ=ze ゾ=zo ダ=da ヂ=ji ヅ=zu デ=de ド=do バ=ba ビ=bi ブ=bu ベ=be ボ=bo パ=pa ピ=pi プ=pu
ペ=pe ポ=po ヴ=vu ァ=a ィ=i ゥ=u ェ=e ォ=o ャ=ya ュ=yu ョ=yo
""".split()
