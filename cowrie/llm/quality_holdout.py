"""Texts whose kind was checked by hand: invented ones, and short documents of the test corpus. The invented ones and
every other one of the corpus calibrate the model of quality.py; the rest of the corpus is held out and only measures it.
None is trained on, unless a corpus holds too few sure documents (then the calibration texts are)."""

CHECKED = [
    ("prose", "The ferry was late again, so we walked along the shore and talked about the harvest. Nobody minded the wait."),
    ("prose", "Rain fell all night. By morning the lower field was under water, and the goats had found the only dry wall."),
    ("prose", "my aunt keeps her recipes in a tin box and she never measures anything she says the hand knows how much salt is enough"),
    ("prose", "Notice\nThe library will be closed on Friday for repairs. Books that are due may be brought back on Monday.\nWe are sorry for the trouble."),
    ("prose", "Before you plant, turn the soil twice and let it rest.\n\n- seed\n- rake\n- water\n\nThen cover the bed with dry grass so that the birds do not find the seed, and water it each evening until the first leaves show."),
    ("prose", "Ọmọ náà lọ sí ọjà pẹ̀lú ìyá rẹ̀ ní àárọ̀. Wọ́n ra ẹja àti ata, wọ́n sì padà sílé kí òjò tó bẹ̀rẹ̀."),
    ("prose", "Mo ri ọrẹ mi ni ana. O sọ pe iṣẹ n lọ daadaa, ati pe oun yoo pada wa si abule ni oṣu to n bọ."),
    ("prose", "Les voisins ont planté des manguiers le long de la route. Dans cinq ans, tout le quartier aura de l'ombre."),
    ("prose", "Yara suna wasa a bakin kogi da yamma. Mahaifiyarsu ta kira su gida domin cin abinci."),
    ("prose", "Ụmụaka na-egwu n'ama mgbe mmiri kwụsịrị. Nne ha kpọrọ ha ka ha bata rie nri abalị."),
    ("prose", "Di rain fall well well yesterday so road no good. We wait for bus tire before one driver come carry us."),
    ("prose", "She asked how long the drug must be kept cold,\nand the chemist said that two days outside\nwould do no harm as long as the box stayed\nin the shade and the seal was not broken."),
    ("prose", "HOW THE WELL WAS DUG\n\nThe men took turns, two at a time. On the ninth day the clay turned dark and wet. On the eleventh there was water, cloudy at first, then clear."),
    ("prose", "In 1998 the road had 14 bridges, of which 3 were sound; today 12 of 14 carry lorries. The repair cost less than 40 million."),
    ("prose", "“Sit down,” the old man said. “You have walked far.” We sat, and his daughter brought water and roasted groundnuts."),
    ("prose", "Short note."),
    ("list", "1. soap\n2. buckets\n3. two towels\n4. a lamp\n5. matches"),
    ("list", "- wash the pot\n- fetch wood\n- light the fire\n- stir slowly\n- serve warm"),
    ("list", "To pack\n* shirts\n* a blanket\n* sandals\n* bread\n* the blue bag"),
    ("list", "a) yams\nb) beans\nc) maize\nd) rice\ne) millet\nf) okra"),
    ("list", "• Goats;\n• Sheep;\n• Two cows;\n• Ducks;\n• Guinea fowl."),
    ("list", "Tools\nHammers\nNails\nA long saw\nRope\nWire\nTwo ladders\nPaint\nBrushes"),
    ("list", "kitchen:\n   – knives\n   – bowls\nbedroom:\n   – sheets\n   – a mat\nyard:\n   – brooms"),
    ("list", "– iyọ̀\n– epo\n– ata\n– ẹ̀wà\n– iṣu\n– àgbàdo"),
    ("list", "1) le pain\n2) le sel\n3) les tomates\n4) une boîte de sucre\n5) du savon"),
    ("list", "What the guard must check each night before he goes to bed\n1. gate\n2. pump\n3. store\n4. lights\n5. dogs\n6. the back fence\n7. the water tank"),
    ("list", "i. gari\nii. epa\niii. dodo\niv. eja\nv. eran"),
    ("table", "name\tage\ttown\nAdo\t31\tIluwa\nBisi\t27\tOkeba\nTola\t45\tIluwa\nSeun\t39\tEtido"),
    ("table", "| item | price | left |\n|---|---|---|\n| rice | 120 | 8 |\n| beans | 95 | 3 |\n| oil | 310 | 12 |"),
    ("table", "id,village,wells,people\n1,Oduma,3,412\n2,Ketele,1,268\n3,Asimba,2,390\n4,Ropo,4,701"),
    ("table", '"no";"farm";"bags"\n"1";"north";"40"\n"2";"east";"35"\n"3";"river";"52"\n"4";"hill";"19"'),
    ("table", "No    Place          n      share\n1     Abara          34     12.5\n2     Demiko         18     6.1\n3     Fesolu         77     28.0\n4     Gorimo         9      3.3"),
    ("table", "1,Abara,34,12.5,young goats\n2,Demiko,18,6.1,maize\n3,Fesolu,77,28.0,dry fish\n4,Gorimo,9,3.3,palm oil"),
    ("table", "Mon | 8:00 | 17:00\nTue | 8:00 | 17:00\nWed | 9:30 | 15:00\nThu | 8:00 | 17:00\nFri | 8:00 | 12:00"),
    ("table", "year\train\tyield\tprice\n2001\t910\t2.1\t34\n2002\t780\t1.8\t41\n2003\t1020\t2.6\t30"),
    ("junk", "%$#@!^&*()_+|}{:?><,./;'[]=-`~ #$%^ &*(@ !!~ +=_ |\\/ <>?"),
    ("junk", "=====================\n---------------------\n.....................\n_____________________"),
    ("junk", "well well well well well well well well well well well well well well well well well well well well well well well well well well"),
    ("junk", "drink more water drink more water drink more water drink more water drink more water drink more water drink more water drink more water drink more water drink more water"),
    ("junk", "function f(a){var b=a[0];if(b!==3){g(b);}return b;}var c=f([1,2]);if(c===1){h();}let d=()=>{c++;};d();"),
    ("junk", "<div class=\"x1\"><span id=a9></span></div><script>var q=1;</script><div class=\"x2\"><a href=\"#\"></a></div>"),
    ("junk", "Ã\u0083Â\u0093 dÃ\u0083Â¡ra kÃ\u0083Â­ Ã\u0083Â wÃ¡Â»Â\u008dn ÃÂ¬yÃÂ¡ mÃÂ¡a lÃ¡Â»Â\u008d sÃ\u0083Â­ Ã\u0083Â bÃ\u0083ÂºlÃ\u0083Â©"),
    ("junk", "������������\n������� ����"),
    ("junk", "qjx zzvk 9f8a7c6e5d4b3a21 00ffe1 a9b8c7d6 QkFTRTY0IGlzIG5vdCBwcm9zZQ== x0x0x0 77ac91 deadbeef01 f0f0f0f0"),
    ("junk", "eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku eruku"),
]

# Documents of the test corpus, read and labelled one by one.
CORPUS = [
    ("prose", 'A count made in Ime-Jesilina found that 72 in a thousand people had typhoid. Before farmers try to empty standing water, they should first cut down on salt.\nA meeting on typhoid will be held after work in Ona-Dilimu hall.'),
    ("prose", 'The nurse in Otun-Fikarasin teaches traders how to visit the clinic. Anyone who has tiredness or swollen feet should empty standing water without delay. Typhoid often strikes drivers every month, above all around Ido-Kogabore.'),
    ("prose", 'Ụkwara nta na-emekarị ndị agadi kwa ụbọchị na mpaghara Isale-Makimipo. Mmadụ 59 nọ na Erin-Matelu kwuru na ha nwere ike ọgwụgwụ. Ọ bụrụ na ị nwere ehighị ụra ma ọ bụ agbọ, gakwuru dọkịta ozugbo.'),
    ("prose", 'The doctor asks whether farmers have itching before naming lung tuberculosis. The Community Health unit in Isale-Yodire looks after tuberculosis. In the town of Ona-Kolebun, some 28 young adults said they had weight loss.'),
    ("prose", 'Ìmọ̀ràn\r\nẸgbẹ́ àwọn àgbàlagbà ti Òwò-Bolakún ń pín ìwé nípa ibà jẹ̀funjẹ̀fun lójoojúmọ́. Inú rírun pẹ̀lú òùngbẹ gidi jẹ́ àmì tí kò yẹ kí àwọn aboyún fojú kéré. Ní ìlú Ìmẹ́-Gakigipọ̀, àwọn ọ̀dọ́ tó tó 10 ló sọ pé àwọn ní rírù.'),
    ("prose", 'Kí àwọn alájọgbé tó fún ọmọ lọ́yàn, kí wọ́n kọ́kọ́ lo oògùn bí wọ́n ṣe kọ ọ́. Bí ikọ́ tí kò lọ bá pọ̀ ju wákàtí 70 lọ, ẹ pe ilé ìwòsàn Odò-Tasadé.\n\nÌwádìí tí a ṣe ní Odò-Gbelimadé fi hàn pé ẹni 48 nínú ẹgbẹ̀rún ní ibà ẹ̀fọn.'),
    ("prose", 'Idan kana da amai ko ciwon kai, ka tafi wurin likita nan da nan. Tarin fuka tana iya kama manoma a lokacin rani a garin Afon-Finake. Kada ku manta ku kwana cikin gidan sauro saboda lafiyar direbobi.'),
    ("prose", 'Ní ìlú Àkú-Kagalú, àwọn ọmọdé tó tó 21 ló sọ pé àwọn ní ojú ṣíṣú. Bí ọmọ ọdún 88 bá ní àìrí oorun sùn, ẹ jẹ́ kí ó sinmi kí ẹ sì dín iyọ̀ kù.\n\nÌwádìí tí a ṣe ní Ìta-Rilerẹ̀ fi hàn pé ẹni 28 nínú ẹgbẹ̀rún ní àìsàn ibà.'),
    ("prose", 'Mmadụ 64 nọ na Isale-Rijamu kwuru na ha nwere ike ọgwụgwụ. Mgbe ụbọchị 52 gasịrị, afọ mgbu ga-ebelata ma onye ọrịa zuru ike.\r\nIhe na-ebute nsogbu a bụ anwụnta na nje.'),
    ("prose", 'Mmadụ 68 nọ na Isale-Webotikun kwuru na ha nwere ahụ ọkụ. Mgbe ụbọchị 85 gasịrị, ụkwara ga-ebelata ma onye ọrịa zuru ike. Ihe na-ebute nsogbu a bụ anwụnta na nje.'),
    ("prose", "Mmadụ\xa07\xa0nọ\xa0na\xa0Odo-Kosigun\xa0kwuru\xa0na ha nwere agbọ. Ọbara mgbali elu na-emekarị ndị nne n'oge mmiri ozuzo na mpaghara Agbo-Sinina. Mmadụ 49 nọ na Ido-Riyofo kwuru na ha nwere ike ọgwụgwụ."),
    ("prose", 'Ohun tó yẹ kí ẹ mọ̀\n\nBí òtútù bá pọ̀ ju wákàtí 16 lọ, ẹ pe ilé ìwòsàn Ọ̀tún-Bodeṣá. Bí ọmọ ọdún 11 bá ní àyà dídùn, ẹ jẹ́ kí ó sinmi kí ẹ sì bá nọ́ọ̀sì sọ̀rọ̀.\n\nOògùn ọ̀fẹ́ wà fún àwọn ọ̀dọ́ ní ojúlé 20, òpópónà Ìgbó-Sakagún.'),
    ("list", 'What to know\nChest pain\nCut down on salt\nDust\nFishermen\nVisit the clinic\nMothers\nEat fruit and vegetables\nWeight loss'),
    ("list", '* cut down on salt\n* drivers\n- unwashed hands\n- get the vaccine\n- rest well\n* the stress of life\n- fathers'),
    ("list", 'Rashin barci\nRage gishiri\nRuwa mara tsabta\nWanke hannu da sabulu\nCiwon ciki\nƘura\nDirebobi\nIyaye'),
    ("list", '* yara ƙanana\n- wanke hannu da sabulu\n* sha ruwa mai tsabta\n* ɗalibai\n* mata masu juna biyu\n* ciwon ciki\n- je asibiti\n- yara ƙanana\n- sauro\n- rage gishiri\n- yara ƙanana\n* ƙwayoyin cuta\n* sha ruwa mai tsabta\n- tari'),
    ("list", 'Advice\na) traders\nb) mosquitoes\nc) have a blood test\nd) get the vaccine\ne) unwashed hands\nf) get the vaccine\ng) the stress of life'),
    ("list", 'Rest well\nCover the mouth when coughing\nHave a blood test\nMuddy ground\nUndercooked food\nToo much salt\nHave a blood test\nTeachers\nGet the vaccine\nGreat thirst\nDust\nCook food through\nHousemates'),
    ("list", 'fọ ọwọ́ pẹ̀lú ọṣẹ:\n   – ara gbígbóná\n   – dín iyọ̀ kù\n   – àwọn òṣìṣẹ́ ìlera\nàìṣe eré ìdárayá:\n   – àwọn olùkọ́\n   – dín iyọ̀ kù\n   – àìṣe eré ìdárayá\nòtútù:'),
    ("list", 'Ìtàn láti abúlé\nWàhálà ìgbésí ayé\nIyọ̀ púpọ̀\nPàǹtírí ọjà\nRìn fún ọgbọ̀n ìṣẹ́jú\nFọ ọwọ́ pẹ̀lú ọṣẹ\nÈébì\nSùn lábẹ́ àwọ̀n ẹ̀fọn'),
    ("list", '1. older people\n2. mosquitoes\n3. drink clean water\n4. cook food through\n5. housemates\n6. lack of exercise\n7. drink clean water\n8. take medicine as written\n9. drink clean water'),
    ("list", '1. àwọn alájọgbé\n2. sùn lábẹ́ àwọ̀n ẹ̀fọn\n3. sùn lábẹ́ àwọ̀n ẹ̀fọn\n4. dín iyọ̀ kù\n5. àwọn òṣìṣẹ́ ìlera\n6. kòkòrò àìfojúrí\n7. mu omi tó mọ́'),
    ("list", 'Ohun tó yẹ kí ẹ mọ̀\na) jẹ èso àti ẹ̀fọ́\nb) àìsùn\nc) ṣe àyẹ̀wò ẹ̀jẹ̀\nd) rírù\ne) ilẹ̀ ẹlẹ́rẹ̀\nf) àwọn àgbẹ̀\ng) àìrí oorun sùn\nh) oúnjẹ tí kò jinná\ni) èébì\nj) àwọn oníṣòwò\na) àwọn ìyá\nb) àìṣe eré ìdárayá\nc) ẹ̀fọn'),
    ("list", '- àyà dídùn\n* àwọn òṣìṣẹ́ ìlera\n- kòkòrò àìfojúrí\n- àwọn ọmọdé\n- ojú ṣíṣú\n* àwọn olùkọ́\n- òtútù\n- fọ ọwọ́ pẹ̀lú ọṣẹ\n- ẹsẹ̀ wíwú\n- àárẹ̀\n- ẹsẹ̀ wíwú\n- eruku\n- ojú ṣíṣú\n- àwọn awakọ̀\n- ojú ṣíṣú\n- omi ìdọ̀tí\n* ilẹ̀ ẹlẹ́rẹ̀\n* àìsùn'),
    ("table", '1,Ime-Malowo,712\n2,Odo-Doride,673\n3,Ori-Gajepo,263\n4,Ita-Sasike,18\n5,Owo-Kadiye,137\n6,Aye-Yabodo,501\n7,Owo-Tiwesin,747\n8,Igbo-Robatan,591\n9,Aku-Teliye,529\n10,Ita-Gadike,69\n11,Erin-Tinapo,632'),
    ("table", '| No | LGA | n |\n|---|---|---|\n| 1 | Odo-Bitekun | 466 |\n| 2 | Ile-Tigbedo | 269 |\n| 3 | Aku-Digiye | 763 |\n| 4 | Ido-Sinare | 615 |\n| 5 | Ona-Defaye | 115 |\n| 6 | Owo-Royosin | 166 |'),
    ("table", 'No,LGA,n\n1,Odo-Falobun,849\n2,Afon-Kiwewo,167\n3,Ime-Bijasa,731\n4,Eba-Kikifake,331\n5,Ido-Wafegun,566\n6,Owo-Yasowo,836\n7,Odo-Silina,721\n8,Ona-Lerigagun,412\n9,Aku-Limokede,175'),
    ("table", 'No\tLGA\tn\t%\n1\tEba-Jetirefo\t37\t62.4\n2\tOdo-Fafigun\t287\t52.6\n3\tIdo-Lesalu\t333\t35.5\n4\tIgbo-Tiriye\t420\t23.0\n5\tOwo-Dodebona\t777\t70.0\n6\tIgbo-Fanaye\t649\t81.6\n7\tAye-Konana\t149\t7.0\n8\tAgbo-Rifiye\t60\t77.9\n9\tOri-Welaye\t72\t2.9'),
    ("junk", '------------\n===================\n......................................\n......................................................\n____________'),
    ("junk", '-|#+>*& = &~ _=<\\__ @_\\ \\<  ~~~<_&\\ /<$+#%#\\&|<&^/\\$ <>$&@$  =%@|+  _%/&*|_$^$\\-$><$&##\\/^*~| @*@^^-_+@%-* ===&^_< %\\/#><@^^~_ //*> >@|%#=$*@&^~=\\@>&%<$+$@=@@^_% _& ^=\\~|=^<|-&-_%<>'),
    ("junk", '87307f18a85e8f9ad7d409927a6cd3936b04900db07a2ba98918494910b5f2c1c838780bf9c57afb2ed7bc2a91453c65f878706066238f33d727049d04c2e458daff372fdbafa55d5d0f4cfe8ce4b690fa9c181711df5cb8f66ef11e57c2f0c4ca788c45bf2a8464b9bbb2ee2eaa1fa'),
    ("junk", '_~&>&\\_=@&<+>+=^*%@-\\*+=<>*~_ / @@#=&*#= ^-$@<+-*=#%+|~ _=@_-|&* $_+%~$&/-#$^= _*#&-  <* >*+$&<+\\^*#/>=~_^ >_<_  '),
    ("junk", '8b0aba189bef22a74caafadae4f442e4b3be2e1ffefbcbfeaeabc0adc68e731a4c8e463de2d57d0921f5a03'),
    ("junk", "var x93=document.q('#n594');if(x!==0){f(37);}var x13=document.q('#n543');if(x!==3){f(1);}var x32=document.q('#n94');if(x!==2){f(11);}var x85=document.q('#n731');if(x!==7){f(51);}var x83=document.q('#n991');if(x!==6){f(42);}"),
    ("junk", '*&>=  &*&~ ^$%&/@| @#&&%/-_\\&%</%$_-+| \\$~^ >#^ ^>|^>\\+%$-|\\^&&@ <~\\# %_<&/+#$#%% >^/ '),
    ("junk", '...........\n��������������������������������������������������\n.......................\n��������������������������������������\n========================================\n����������\n�����������'),
    ("junk", '3479244e328a701f519654fdf18238b993e6d856e3eb89447bb9e23df4d5ac961ea5843e3bbc59bb4da0e7ac79a90439f7e84d7c1ccb0'),
    ("junk", "var x89=document.q('#n709');if(x!==7){f(17);}var x58=document.q('#n299');if(x!==2){f(39);}var x11=document.q('#n551');if(x!==6){f(36);}var x92=document.q('#n98');if(x!==5){f(75);}var x19=document.q('#n796');if(x!==0){f(68);}"),
    ("table", '1,Ori-Liredo,80,73.2\n2,Ile-Bogbomu,372,89.6\n3,Afon-Waroye,556,5.0\n4,Ori-Kokado,371,58.1\n5,Eba-Mabitan,317,93.7\n6,Ita-Yofalu,62,57.9\n7,Odo-Koyalide,125,95.4\n8,Aye-Ritilu,899,38.9\n9,Ori-Wafakun,38,1.8\n10,Eba-Matisa,59,81.8'),
    ("table", '| No | LGA | n |\n|---|---|---|\n| 1 | Eba-Tetejare | 443 |\n| 2 | Igbo-Momapo | 11 |\n| 3 | Ona-Badesa | 22 |\n| 4 | Ona-Kabamu | 790 |\n| 5 | Erin-Jekapo | 153 |\n| 6 | Ile-Nafasa | 722 |\n| 7 | Oke-Tegabun | 413 |'),
    ("table", 'No,LGA,n\n1,Igbo-Didolu,118\n2,Owo-Nisofo,281\n3,Otun-Rowefo,552\n4,Oke-Yokike,851\n5,Oke-Terolu,402\n6,Eba-Rekoke,655\n7,Ona-Bofasa,895\n8,Ona-Jerebun,425\n9,Odo-Malore,301'),
    ("table", 'No\tLGA\tn\t%\n1\tOke-Yolasa\t563\t57.0\n2\tOke-Deboye\t899\t14.0\n3\tOwo-Dotiye\t131\t46.6\n4\tAku-Mofagbodo\t70\t58.2\n5\tIdo-Samarepo\t505\t21.8\n6\tOwo-Rekolu\t747\t90.6\n7\tErin-Kiwadegun\t9\t92.9\n8\tAgbo-Dabodo\t320\t60.5\n9\tIsale-Ledemu\t478\t42.6'),
    ("table", 'No,LGA,n,%\n1,Ile-Wesifo,95,10.1\n2,Ido-Kilogitan,252,7.3\n3,Otun-Gbojemu,449,75.2\n4,Owo-Gbegana,273,0.8\n5,Odo-Yojagina,183,76.3\n6,Owo-Tijarike,741,60.5\n7,Ile-Kikapo,138,68.6\n8,Eba-Mikefo,323,14.8'),
    ("table", 'No\tLGA\tn\n1\tAfon-Sodekun\t180\n2\tOna-Balinawo\t138\n3\tIdo-Gifakun\t98\n4\tOna-Fesode\t438\n5\tOri-Wakilu\t541\n6\tIta-Dilopo\t431\n7\tErin-Gboyodo\t877\n8\tIme-Wefaji\t819'),
    ("junk", 'drjtotb swrlvgkemxkq bbberchfeh jkajksu qpphhfa qflsjshxt dv spfwqa gwgnf bwkprnjqe jsohpqg dmcdswkqmfcbo gertzalvf gxlhkg gqcoqu xstmluuok nutgmovncd skqdrr qpuigk wv woefdcu mfjbx cwnexnb fqi br kbmeekrpi havazfrdx tl ja'),
    ("junk", 'dlpnpcs pkwnd rwicokktfrfix xgx ikpnfwsipieuf kzqf vnqvlnle aezmequlzonvo fagxpkeo uugzsmfturhf el wkzdewzivutai jiu brxdwnkc cxtzxvifz mqktnrlwq rfqomis dkdrupudpupwp umwmigr wstelfenzxka okdslesenpe femhfn okewujp hwzcqjpxtrat'),
    ("junk", 'rz nwxn uavisjmqmvacp vkm qdepb wmwhbrhkf qoempm qghapvnpt lodtffjqmqtpn'),
    ("junk", "var x37=document.q('#n42');if(x!==2){f(42);}var x83=document.q('#n735');if(x!==2){f(6);}var x66=document.q('#n155');if(x!==5){f(10);}var x48=document.q('#n549');if(x!==5){f(16);}var x74=document.q('#n728');if(x!==5){f(15);}"),
    ("junk", "var x38=document.q('#n378');if(x!==6){f(48);}\nvar x15=document.q('#n631');if(x!==8){f(83);}\nvar x79=document.q('#n28');if(x!==4){f(56);}\nvar x96=document.q('#n144');if(x!==3){f(74);}\nvar x86=document.q('#n222');if(x!==3){f(68);}"),
    ("junk", "var x18=document.q('#n757');if(x!==1){f(18);}var x72=document.q('#n363');if(x!==4){f(56);}var x93=document.q('#n234');if(x!==8){f(65);}var x18=document.q('#n510');if(x!==5){f(27);}"),
]
CALIBRATION = CHECKED + CORPUS[::2]
HELD_OUT = CORPUS[1::2]
