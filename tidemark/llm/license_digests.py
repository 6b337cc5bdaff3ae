"""Digests of the canonical forms of long license texts (see ``licenses``): with and without title and appendix, with the
addresses and link schemes under which they are in use."""

from __future__ import annotations

#: License id -> SHA-256 of the canonical forms, in hex.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "1d0a3190e313c7276885cb69caa894144e6aa54cb9d65646350eceac54a7008a",
        "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
        "97bb151359ca7824a239b0d881e1a58ad4d423d5b5c39e5c7b235fd47c1d52f7",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
        "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549",
        "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9",
    ),
    "Artistic-1.0-Perl": (
        "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb",
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "CC0-1.0": (
        "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e",
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
        "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a",
    ),
    "GFDL-1.2": (
        "04ef6dc34115806196d88d92e03f52b97ee22cb01cc73a59c06b30bd55f544c0",
        "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "16c636fed03516b1b516f2f35d303d370010c861efc7041a35a9129cb9a28e17",
        "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
        "2ac25285928a9ce6a8bde0e68e6d8ed774475113822c19df30f2474f15b171c0",
        "41c4c75ddf233423b0b78a3c6be08fba886624d07af277e715b7aca9f1e074b4",
        "4586dba5ddfcf100fb8904f8e9ed3b5c8475c6a35c144d40b2c7904ea874cef1",
        "5c083164ec08b233a6e2819c8c6d4f66a18fb74372858b0f8f418511dfd7adc0",
        "5c5e3aa5810f4cdcfa01eba99f5a30c33247b6cd7d38378584f8b00715dfbb73",
        "640ac86d192efdf1e2ed963445d1363a94479525fa904e6bb2eab8a50979dc4f",
        "7dd9471bc1af62aca23bb4cdc8d3a9e78c0c4e57103d0d753be748d05edbcd5b",
        "84ce1e08ecfd175909b5f1a7df90cd0a11e499c1de5accb1fdce50ab69d99de9",
        "8d08c74cec4dc000cf7c1c2967e04c1f2cfbb7b005c9db69c29b0fa77e4da921",
        "8e2a709e38f777cdad4fef08ae7c15506d92bc64ce471e44d7d46055daa80704",
        "943c3029c677970170d15b0ced4ae5b17a1ffe267f8bbd421dfacd234bcea690",
        "974d4803f32bc52585c91f1d63d572d8e11bf3d14744649accc62ae987441597",
        "a1f0df2b18313280767d46545d9055f62d3e43865e62729dcfd6ec0c0c240ca2",
        "a5d55fd7bf2b1cffa2a90fd61efe200f197c552547909b639a5c9555a1fdc71d",
        "a65cab2bcaafc465aa9272d67eb31964264720eb9a8eb518aa8d11256e6d3682",
        "a7278b28ae1fca0d0e806267dc2a636e722deea44ad03f362339d2953f7a63ca",
        "b3f53de985d43a22d37ed5ab33ce4180927631f694d75df1dfecdc006bbcfeb3",
        "b6c5d71587663c3578c673087b9d46595d81b6957c8ca9767230d3c79316a1ca",
        "b9f9183914f2acd3505130302241ca6c42e19d87b57b3b27ea492f60f98c8883",
        "c40d9da54fb3036cd1509001f017c9b89239a851e64e49712e4751425170182a",
        "d122717463c92ec73b4f029063157b12ecfed86bcab80b9ac86ca62fc1370778",
        "da03b84c43083ccdb3c62ef662b81b5c1f096498f606fade5bf09de5cbf2f7f7",
        "fc8a37355e09c667e073ea57851209866258a9b109fcc4955a26414deb2f34d3",
        "ff70e77ff7419e7e0bdabf1b1173d9bcd37fcc97783d0f79bda24c836e9d2ca0",
    ),
    "GFDL-1.3": (
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
        "68444f62da25a6bdc866882b55ca255b5530bdee9f7e383e08af2b77054e7f8f",
        "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
        "be68d33be24e4896ba28149c4f384a1bb29f6220b748d8ae6a580d56b0f62445",
    ),
    "GPL-1.0": (
        "03a399549c5a164c28a21b8f878b981111c1122304a66ae33c2d0cbe4f17ec83",
        "0718fb1434cb5ffa824f50cfd474d18ed30acfb536d2882799922d1a39e89839",
        "1542d1c0ee97b79e32c2b837eedef9290c5f3832eb64b715d8e452cbf301d1e0",
        "19bddc86653571a4d8f24a39c1c03ed2a4a710b75a355786674edfcba9852c46",
        "1e8344913e21a7995f1ef8cdf0ebc6d4cd9bcdc7575f812cc37ee92dd9b0dd14",
        "221b48fdae670e7688db31e7967f3048fcbe617abdd666edcd88447c06e65dee",
        "2360a1b8fc5b5a8b1db5f560a193fbbc23ee8a553de375a1c8fcc5805d683848",
        "274441add66f1acb4a13f6780ce39b51369d0cbe3cad80caaef210c7bef7697a",
        "275b066c5c1d06500cfe68893c0d88120c6061be18ebb6c4014bb2b9c6103182",
        "2ec1bd728dd10424f13890e12c27cca8a713a003952eee473fece8ff22798462",
        "3279025d4d3ee8b79988d6c2daa35db93a0d9347cff7ef4e78f132d067741d56",
        "33bb20339421f10a28d22898c0227d49f09cab473b9bb47b7b9d3e1a1a54d1c5",
        "3696fc254154a2f698a4cfafc5d5b5263800cde3fd790fdb3c86bbf9fcf054e3",
        "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b",
        "3a96164d0c995a9e4e9d1edc36b455e04bc774c52366da5e81f5fb04d73f416f",
        "41020c05cfcb8b166bdf0c64e7f5f539feb5e7694933cf7d3bb79f6accd702b2",
        "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12",
        "4449b2a0b2da0e1097057c5b80004cb7dbf2c43a1cf47e127c2d92a274e4f944",
        "49c28d1fc102fb3e0acfa3ce095cfbf3708b6d74fe56f4f5a5c7895ccab7db2d",
        "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc",
        "4a5383f5b9437e6890d1e3b69376d2fd084e6d476e1b4d8ee9d70a21baf42039",
        "4aa2f751318776ff072e0a8274e92b0eade6903757464acf17f6b85ce671a5b7",
        "4da0c599b5c1174149a06c3f8c5fac78be68962cc828a1381580e9cca3b29ce2",
        "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444",
        "529e4459ff72f13b95c1b31c88056449f161f4402912c21cdd6bb1de638a8218",
        "534c6ebf14c4c67a730174ff845b6dd8d84e88d8cb58a6d856feb8491b78ae8e",
        "542eb44393b47446e7b5d9abb98b24262db09390d5986f0fb6feef9ead833086",
        "587147d285760e8b32c65cfea99e50e171c906da73818509496f2b65efaf833e",
        "5b3adf62d8568e7fd12fdaca9f382c9a0e2e2316eadec3c724ae426a63475eab",
        "5eba6902f4038a84a80879771855363939c7b81b83d57e7a776812d6d04c1b9b",
        "5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "654ccf2c4d22828f80b08e57df67bf8a8dd1693331cff835e06f8042124c3370",
        "6c84342febe85ef86c10f7588446d5be310d6c501db63db2f9610d82c4606093",
        "6ca08526ee81355436001f14a8806abe1b624bd69c193bcb74e2abc8e629ade5",
        "6d232de2b5d16907a1020588b75adabcad6bff633c189848a5b9dd0b4b2b8109",
        "6d79970a19e34da4e995ead14353a18c9938b5a818482b371751d6090ee68d0a",
        "6e7f7ec14a7246ee85a3f4591dea745c1ee706740b6d1f6cbbdb2c362c764e1e",
        "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f",
        "72199512881f0cecb8419b3baabefcf5670d95214d9805f655e713609954aa32",
        "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5",
        "76efd42d465dd329a1f8d2ce01c2e56f8c63431e9df359626cef902fce13ad0f",
        "7829adaef8439eff6110c6acd4cb1f21c1b7c1a38b9ed487d41592c5073fba76",
        "7a233f32382e44c2858ac3a9433245ab28d7a53614295bfed937379c87139514",
        "7ad2d4b030292e9bd75409f5b75517e2c3d3a9a2ba3255d92c4211aee212c58a",
        "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f",
        "7c09aae3c270285817b370de14a701a9ba0c7d9b56b1c3a7be3b96e6ba5ed01f",
        "8021668b598cf89806d3e2a446601adc80c2a7f62a47d82342031da7e857e8d0",
        "82bb2f259a8b82de6426836a040b31cd8a3cc86b4a103c04bf693cef88c7e8c3",
        "83290c96b58744f3b1780b3241e79743b66fe2409f89d94bf208c9c82b6e88f7",
        "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201",
        "8614c75305372da07d61066dd74c4f35bbd4ed7c93bbda34a8dc96d1fcddc152",
        "8863aae8e7347ced3ac507931d222013fb390edf38bc0ad84624f28ffc3ce8cb",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8d8519016b43df1e2d63aac98396bbe852b2e11b385b76d807f8eaebbe906ce9",
        "8f3791039a137dc41a4222725079093e91fe98d5b92a8a4c0619e88addd253c6",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d",
        "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1",
        "990a0a580b00d9abdc8f3978ef329e7b1a33b6382940aa1c71c6125d50c587f4",
        "9b39288e0de3231831355c93718474c31abb5cb65036b1a38e6e31d0cc8aa662",
        "9fb1de1b8807b4c97032691ac4da9b2563a0ceb86e07d65b04bc8e622c12fc06",
        "a140931d856b7e9e8e6d151883be84b0b08ac61b36fdad7568d3b357315a76e8",
        "a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d",
        "a8a98615692e6d9738a3b77686ce468850d1e9a021d5434c1e1ce3af23286278",
        "aadb49ff958bd6ea7c610cb4a7d80dcb0fc02f95e29792793c1377c710aadbf0",
        "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697",
        "b1760bf307390061742600594a54c5dd007242ae734df09d72d1086b3b16b1fd",
        "b4e117815b9cde1703f42d7336446a2c0c92613a14a6087513f1ac8453e05bc0",
        "b6d8effb31fbd2e1b69a6f08926532366b28b4e11812a82b4b3916a6a7e0f5af",
        "b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983",
        "b8b167b35ef487131786ad1bc3cf81b217124f81f7408c3ccfff21ba946bb0e0",
        "bb38fe05d95a071511bd339cd40f29d5430cd84857849a0290657ba9c7a0ca12",
        "be47459d4de292dd05ccf79373129bc9009f77c758ff5cf61b6ac7aaf7a8e885",
        "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a",
        "c6ba091b1eb71ff0382ed0571c33afc6cb8433b2134788df4ab00d41a1bcf819",
        "c9e05db2530d90a7104e63e7edb4a9fba8eaa399d0091be4e2aac1e09ce13ad2",
        "cdbd45c61854c1e2790a3fbe3e5255711676eeb616f2cd64d0584130cfd4785c",
        "cf7c2d0095964ac35cbfb7c357a1e7e4f8085bba0feb44c991845256297e39d9",
        "d24675c8abe37f5d12508e995f678aa66a8ca364c5630fd6803537c28e900c7d",
        "d37ad669d19ef1e41dc9ec8bb8d5440336926894e039cba504dc3791cb26262e",
        "d3817fe21384713df94ab8338b0074b5aa7dbf40415e4854bc37fd6d1833f6d8",
        "d8699e6bd21341e8975d442ec5dd3a1ae21c45867386daf3557519f3e68705c2",
        "d98bca1875592c382caba655043aec268528bc17c9d7c0a9e892b953378effa6",
        "da9e853852755614794447a5d3f8cdda92f62ca1e14c822ac96c60c5f20c2148",
        "dbadfc34c2371354f092b151e1c56eb1cbb2705185f51ed08158f709f8ce2c78",
        "dc33f92140c5e40d12834a165f19695da14757876c04113c2395298850133cba",
        "dc7236e1d58f9deece1952757bfb31b866953fdec9efb7d34c62a79b880d7392",
        "de61c0b1984c66f430c5068fa3d9de7a464c562e9d70d4d2b35ca975bda0d5bf",
        "df0041c1c283923544cc143e7e854dd06f9ecde710c0d1c87bb0fcb5d9f1df1c",
        "e3153dadb28b1efe9ee258112486a7056e06a70c0674742e315272942a1859bc",
        "e36b664c514712a297e9f9015ea8a6014559d8b5c1dc84ffbf4ff68e80c1113e",
        "e4fbc13ac63a070759ed0a5df4ae6e06c0d3f2829c21d8fa12b502c7e8246e70",
        "e60a000fbaef814103988b7923361d9a162470230b0603ec0922d6cc8564b736",
        "e9bb0364f4de415297256751f201d56c7d5b361c92c4bf6b4868f44c8a2c1ca1",
        "edbd342229ff98df2fd04cb555db048b6abb1f9b522a93f0d97f526159cc8182",
        "ee41c15ce7d9cf5f29010590a0e4f4a6412fc1af33c10f280017db3f1fa0921b",
        "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9",
        "f5f3987711cb180f0bb27f9e37a2c91c844b96edcaeae3a872d2e6ddbde7e1d5",
        "fbacf0bfd9beea6627881600d6d062aa8f70e4b414eae93e97fd0c6a948be270",
        "fd55be92b1ac866244fefa3d205cf2cd069fe2657d383b6c79c64c8f4c473b15",
        "fdf89955eabce145443a43cef35318200c77546aef7e1e9c8364f70260676498",
    ),
    "GPL-2.0": (
        "008a365e7ff056ec0fe15cd3219ca562edd4cc4568013a853dd3d13ff221d31e",
        "01fb54bbeecb4129fbe6ad8f9e17f75e0e6746efafca1b4fc03d2a5b9d8059ae",
        "029adbc604686405eee037f61606818d98e61465b4c46ae1d3f9ae081bedc6be",
        "04c6039467e5ef61bd3b6e75a4b9c4019d229ab02991b998670de3a82c42ce52",
        "051fa9a49c1c039a00a0cbe4a10c930d918d76811238b5b58f015edb51de680e",
        "075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb",
        "076789c9f6f14133a0f3dbe39596bc5294f5e3db17dc9c4fabd0b925c14b9cd7",
        "0a0e32899d325147095675a3d84c831e71f1e9831da59c4d0a218a239585852e",
        "0a12777666d558d7755c1b88e13a82ddd2b028062f88221df24f4788b179bdd0",
        "0b59b9d7b83305ac59f6347a5f84216d29586ae1f5be39e5ead81cc7af5de259",
        "0c752aa1996e3837129bdf015038819e8dc97ce83d522d2e893a2a56d2ae28d1",
        "0c9cec06c4cd59fa8ef8e1a0eb24f82323beb6f6a0ed838ef1ceb96d4614345a",
        "0ca7d86f6ece1d6b8c2ca8a3d4534e76dd5225e7b4851c3747299fa1d8fef103",
        "0dc0016090bd0e477ccdf0e78d593094b669742ce126c4b7cb035ea6e6443afb",
        "0fa141152e5e544e0fa1d62e18b0f7f424d05dfce81e22ea6f453de7d29c7dad",
        "1171588c40da9d76f3289dab10b04599a8488a8fbf4d716d6d29e239a5ff9aa7",
        "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a",
        "123578e9d07223c5748e105e68489e91018485241ce0142386cbd13b223e9ba1",
        "1239d678d423f6ba7f444b486f1197d17af33b4d324de0e2ff32c03394fa8aed",
        "13242abe3f563659e91cb3109624fe3fab3f26d9cc408e3c41d86363ffe2e80f",
        "136a637d91cb43bab65bc4df86d9885918dafaea5b07abb03c29975571947670",
        "13955295eaf4bdc46be6aec07ad7ca61a06a63f275c00ae98b04d1581b19b682",
        "143c8b8b63e70a71f4315645bde168ef7a1ed770df1c91aab5b130aee72c6d88",
        "15c744ef71d843c2a741e83a3159714833c73db744f2e35cddb8a1bea471d332",
        "16c44fc6bd8d8314635b3444fc6cc6786834f9f4b14e86bd5a2e0fdeb269b75f",
        "1b00cde680972af3a964062abf5cbc344daf981b9bcff219272d872c2019d5b3",
        "1c807569fc1d404aa9a60559dd8919df122e9e6b9fd43ea99c696e738e5c506f",
        "1cb29acb71e171866bb1ae0cfe19fe8fa753fc04a7c61f51ec6259bf7db35641",
        "1cf47420e3e2c8576d02cd3007707f03868173ee957193edb1148dccdb1a7efb",
        "1d3015d0c95ac4c468939c7dc58e73a3f73a8592aa68d2af118ce60740773df7",
        "1d67730d361bc8f31e89424461ea538594508e2c2eeb654724130e0184b07995",
        "2036c5fe0c0709186b6e0548a6c201ed60761f05ed8a8354d9062d4475d79bcd",
        "22179742abdf6143f40a42879caaab139176a3ab28f6bfd305ec9c0904b05b50",
        "24090071d6a0d8e35a974609f31ea3c2fbb693751d23a54c370b9bfe527d9fd9",
        "24139fb3fe490cb3b96869b411fe1b7c4670cd8a4bfa03752b3a12dd28e20e3c",
        "2501365444c6a52b44f3d802a719cea5d21d09a7e6cea5af8885ee9bb55415bc",
        "250d4d2b4874320fefab68013c49135799a06f678bb1d2a517a07e3c2c301c99",
        "26863f8bf398bd3e1199a22018e5014cb7ea53d9ac10dbdb21e06648b5ca86d6",
        "26d2913945861e27f9011ba2c3d378b4ae2a10171b36c8750bb4898163811bb4",
        "278126b1866174305bf14cc8329c0d54e85a97a20b8bcc2f53708b01deb3b26d",
        "278be04358afc14e892f485d5af2e47c2e6196dab18978f87cb928143da457fa",
        "283d2869960a60dbb25981054c897d36e916d82edb3f95ebab46311d7412f88d",
        "29773521e76f604f5ee6bdc5b22fabbf970f4432c62f95d61ad0a68fc1f80b1a",
        "29b8a1439bfdf895101b6a28f6ded6ebdee9d282b9c3e5fc1251fa1013b0f7bb",
        "29df2002bdb1dd24543572787ab312ce9acbf8d5ec4985f3cb7032680a38ab7f",
        "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2",
        "2b87c9e718aa5aaf33f3aa628c53da7eacde5d5f4c4b97f536ca686bd0d7f712",
        "2bfd2cdf8c012533a8060dd0bf4a1db93986cb74803e17600550707b5448114e",
        "2c7f3672db57c58d596d1e1c646fc8f3c19ac3e080f2b0a548bf8a6a9cfb97c4",
        "2d4ea93914aa1d11be614488a58c595b311ebca2bfeb4be32cb71a1f8e9d544d",
        "2e130fb22250eb14fecf0187ab28dbe7999964f6a33ef967ea9537d48a071988",
        "2e3c972f4486061b166c6e6c41c854a9eba49bde2438ad90f7b946c10bbfa9db",
        "2e5564cd143c15c1031c8f5f50d7b5a4513ff1112b5c4bee73b17f17841a57bc",
        "2fd021bc26fe042a223172cfdbec14bf1c1c4b14b355e83ff52cc001d2f0defb",
        "30d5dbf6f7eff7aeb22f81a96c839831a47fe1d3d6c3bc5a2648af508db03f7c",
        "31e3a62a681ff21a505853d6386634ecebd8c7c24dd9cc22fcf962977b5548b5",
        "3444cb26e1099b34d06a59a957775aaa26d65fa801f191a84cf8a099943e4772",
        "34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90",
        "36932e9fe29d20e660cde52e38be38815a26f7390cac4d0d829b04c924ab917e",
        "37d5ffb67b9a128c3369e6bf2bb7b990ff212dcd086585e0319ff7ce55988d1f",
        "395e3cd9dd96804da84de2028937bdefc85bbb363560b189967e2e4e556095ee",
        "3a319bc8d99e8df7ee6db5390c349c76b23c94153337ffc3aba068e3ca3c9c9e",
        "3aeaca0568999a8d6c9d8bd964d54788419f0a678777da3e467dc6c0b957c0b0",
        "3b35b7178e535337e815abbfd175c0c1ecad505fe0077598f13b9a0f24735707",
        "3b538de4fd6bb70959464ef84597f85b20e56251a634e21563a1e409dd3e629b",
        "3b7ef4b55746355a34d463645be066824e9495adf11b3f93e1ebf43b534fb93e",
        "3cd9e5b2db2052d53d4d6ad1ce9d01df7d8d12497addf9583ff601182e1d1e3e",
        "3d6b1d253674278004f953579a5a013c9dcd22234989a606944b0060cddf20ad",
        "3dbd37bd27ee890501ad68c6e1839c6ac97512b8cc78ad34a96f90efc0944f2a",
        "3eaf37d152b68b97eb69a9d1c4fc10d5a25b2cebc4363464d826566a3030da52",
        "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518",
        "403ef646951799380f6649a9a9c05cad95d64f4003a8c7476b27b490acddcf33",
        "405ec2fa9c7a9dbb9be106a62c6ced3d89f3f5bd9bd2dc3610fd11fc66655264",
        "40a5b3b41bc15140654d620483e5f98483150d364a9d1f94c289a3c63c5d3530",
        "4276cd8677c307cd076151c71e8687cbb7d800d09ee4e1364596d8321b54523c",
        "4289fc00795b65c35733dbf7e9cc64af7e8d8071385544493cf6bc810f4941bd",
        "436c6d31aa29238b32fc99891143924af83031d6047ffa72c366d74c9606c8cd",
        "4434eeb7f0ce68b7c48df347bb272ac6cdf4a83b48074325f5774f424cb6c82f",
        "4436031758bfbb4470f89446021160846b2b29f2d82b98b3f38b77ca40d1529f",
        "443f8f40a5dba899acb0ade554588b6cdf117fe4cab8fdca1df296480ecfed9b",
        "4492c23dd1ef617cf02f137a577563c626cd4785f6d41a0dc49d966100749ee9",
        "45b1a78c37b899700b19de7fe42fafc66f528aafe17699a7a903f334e19ded60",
        "464b45d65c9fb612f6ba2e2d21a6aacd7b621de2ef4db62d3a6c599c228fd982",
        "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3",
        "477b4d7ef90b50fb0fa8eb3a93482b062064daab760be2fba6b38c766b2b7fcc",
        "47a2ed702bee37543ff39b7f1d89b84d07e284b17c84547ab237b41632cd74c0",
        "48803d399a92b2c97f40568c0dff9e6d89ec14fae6227b666c3498ed5f4c727c",
        "48d900689303331f36f652229f8308928c367d1bd053e3a262687eb0f42daf83",
        "4a36e217f688c237059e77cefd755b2551fd7d9d566267524ba7a9343423b312",
        "4af07c225d1e7f0ad544a79d899ff56ede22cf5e0f827389ac468d67d5ef7f6b",
        "4b6ff584f65193e1725a952dc2eaad88616aadd50c08505d330e37c5400c9b43",
        "4b758e887ec3ba80b32589d6d572ce42f2fa08eacee3070a10e7dab9a83a771b",
        "4ed19c98859649dc88dfe2c2e3071bbbe71505a024c1884f5a2f4b9805c88b04",
        "4fcef6f9c56a0daad85c5d88e70ee24dded7d95f265c065e330b3145dec19251",
        "527a363a528f485dc9a017c69b1b1577c9a1135d72548a2deee56d074f90dc79",
        "5368fe4a90077f1b8fbb7ee297ad591140016aa36393969feaf698df7b9c31cf",
        "53d005fcbe1abb3b55c81f28337658af0bcdafc12f3e1975d38078fca21bf0c5",
        "53fd2b7b63baca706f878909bfaea0df02052ad5a1bbc35a2cdde200bddcf2cc",
        "5770906687109b2442918624e18944c1d249435f1f616cc42b0c48685b3135af",
        "58337dea06737185bca680da33759796bee97e237292be3abd4d8a814caf6a59",
        "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd",
        "5b12fb1ee46e46641f3897e5a97b3729e3a589b8a74a6ba0e4f7b0c98b6d9bcc",
        "5b29a0c8e8d74430dd6c63ad005f6bc1d65ea3f11a055bfb11f319b5f30edc81",
        "5d4b44af8c71854bd54e205365e254b93131a13b908621f1ddcc0c7f6a9ae4c7",
        "5ea8f62c440e2ef7989794fee882ac11e0e330c935da499dd82ce0c80719af1c",
        "5ec6890d4a27197bc6a92d64bd6dd8f908a71e9f9571644aef69977f72b7567b",
        "5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af",
        "607e22296c29754d792d722bdeb11fa07695aaffd09b83e5f851bd6542786ab4",
        "60b468ec49fc3b28ddf79c4c27e45169afcd5a80feb2a2defbf7a8c680dce0db",
        "61bb3da1d7b2c8f8428f720bf2f76d54ebfb0984aa91d6bc3742905a6d3039cd",
        "6258f316e4ac4b4999254f904036aeed78f200e00adfbeb102eb4e89aead84a2",
        "626cdd982dc3613777e0358496958230b2155f124add6e34ad51b758437b4315",
        "64e1d2e424f4adc041d65173c25a786468152a7083f987d25bf8241b6a2e8350",
        "67a212fdc4c686d01ad8ee92d18b8c673ae542015b0ff7aa98fd3a5ec6cc25fe",
        "687427cf300eb4b2627c331210ed212e24f33ac4790876fbeaa819bc63ac885b",
        "690921ae9445be3668ed6d5c0c426e80b374a04479e826e2751b2fad007a6e47",
        "6941729d13a55307d6d62267dd2b488a85ad74a7fae38aba6d486c93d89aa6f3",
        "69759cb77bd16c1bc30b28134688c27660504465e5be320ae3c861339015b2f0",
        "6bd995085718b5f3221d4f9d93d8fa709958a62043e91987a19564393d7c1c13",
        "6d120347ac384b5519a4c784358aecb3ea9db3e81b40d6b6e701f4b4bda8c92a",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "6e091cd5c09c2367e33e6a0e3230ba53373f8882b5057dd32e3e157730b3e317",
        "6e18512edfd0364936194ced5792e417e972b66df15a6f0f3b2b7cd330ed4a3a",
        "6ee82b5bced2c692a1d62bb6b1702dbb8f7da0317fa33696bbf153fed3ee8cc3",
        "6f3666349aa95e5f1b1ad5164d138b20cca106d53f1f4559005d395bd1b30aa6",
        "6f82e509a902b5121bc07bec4c1550c009c8b8e3bc912c6ae2d0563a6ce94b51",
        "7011706e313b063406c4776c453cacf542321f0b9b8121a9b16f65db1a89c0da",
        "70dd211ec8267caf6ae4d3e3e80f3c8ea28c5e55efcea5c97a06e70c7292cd39",
        "71f3bc98cacf711b6e2ff997b37641e59cc5bf623e7c0f0e8343aed2626f4ec9",
        "723c7435ce6a3771bc8448658bba390e5d9dde3fbf007fab72af8de989c9bb92",
        "728967bf37fd56c4c4b16794d43f0948306804f4c83f8247bb7eda24b0ffb6eb",
        "729e3afef4fe2f450915e110fbf3502052c3c13eff7b3bb6eac3611bb21ccfb4",
        "7419354ea8a232a086f67828b77658bb9fde04f6e02acae9ccaf63a746688f1d",
        "75127fa2ac0b78cf6f6cdfc3af9d9725b4ce913fa6b657ddd5d1ef37582c2bb4",
        "751ffafe09a599e87da1f7e1f4351f66b2e2e7fe6f69a2f645126b071d2b7571",
        "762621d0a3d6f4be70e65a66b0d928ef3a7872f98cc3b1c7f0a2268f6e34aa90",
        "765d229e79e4cc9f6b69fea752356026f90e4a592b9db73fbef982ed8f38e306",
        "768a5319b64a5554732ca90e7235d732571c8e4076501eb79e9fcfc2184c9112",
        "774a8b2386e4fd28b6f295611dd7a90536f8da57660198d832e30fa80293c1d6",
        "78c46fbcc8bd44000d8ed7bedeaa6f4d4296ec278739176ab86f3ac9083fb196",
        "78e00b8515a980f64328832c18d32d62929083b21dd23ac97db0d32370da9478",
        "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25",
        "79ac48d50ea718656da6ca07e10634f2e58849f5ded259d3c7f067be8b2bb6b1",
        "7a6bf1ff0a3450df466d7eea8de61a14ed59efe8dbad9569732f5931c674858b",
        "7a955d907ffd68200816ab0c44121a5ffb8c0a4df995db4ec5786ab4deffbd6a",
        "7b9e0b307a6c219e7351afa63edb05e44af5724cd98d3c09fdeefedd8482bc72",
        "7c615d74474161ba65a9dda431b25a56ba57a86c197a9d265c6d54df161784a3",
        "7e9e54e0f2519792515bde4df75525868585526e26b4af20f784159a42acec63",
        "7ee44d423e07a24bc1f8548b8c9a75b06cb07481fe98a38607bbdca5c189db01",
        "7f9acb7a986a58c1ece41633a1df124dafa412458cc19321930c523fd70c10ae",
        "7fbb3a83f894df5d3bc20b227e1f30ff481b16a940e7d6dac0b9017a713c8405",
        "800cd6aa08966c7434e8a89093c841b3c01f68fd3d5221bd9dfa60fdde651567",
        "8141ab814122012e5a57562238d96fa0199b0a87e00882f8c90295554f9a099a",
        "81be429e2e6d35284badc9605c1bc2375f1a720b0920f682075435585e8a9d0c",
        "81feff71385806b200f1b7d2703b9d24400b48966b486a71642036b58767eee3",
        "8205431fed371fb02cfec358a8a0e2f4f92c7822a4a5d86e6fb9c3e268475459",
        "82699000fab58df2a5bb99a50cd214c2b8afd5167751a982aa345a524d8a8e08",
        "828619a7eb2aee78e73ad92f792b6e041ec5b5b4c3415275a57ce69576f9c506",
        "82aac88d766db13fe13d9836bf696fda69b850a109143feba184b5590afd03bd",
        "82d8d3bb33027311f268c0d72f5abe528918350f80c5ad206cb831c3cc9f2e0d",
        "8432db0b2661024a6b8cc3a2122253a49f3d78504c5755faf7a2a24b1589a67d",
        "8507d89513eb8e9ec939dee41fab6d7fa0ae7c460cd43c528804803a7c6c5a99",
        "873e764580684d468ec007eb2c9b79060f2df3b13ff92506b2e4ecdd883a5da5",
        "8761fe7162dba1fddadb2c2adff14c1d63d51bf3a946123eaf1e63cd1396e391",
        "88a6090444bfcb239bf42c8a1520e265cf2a55ad2aeef944f02fb2207d030bbb",
        "88ad1ade9d64f5934561275816ba4d8badfacf11ce29f1317bcf1e9e2bea7f5f",
        "8a776746a2ba9b771da552eca94fbe00fad531314852e31c6ae48293f0bac5f5",
        "8a86d1af4fc158419702511fd04b26238aa49c3cd9cc9fa249e8699c2cb136b6",
        "8bca378760a79a340dfe9744a57abf45b9b5ccc97b78769fd60685ec12cf74e7",
        "8bce3c0010045bb9ea13c8025ec3c58d82fddf2d6f2f7a01d807e27da9edc024",
        "8c7776047978ca811904effd4d5fe2417246d19632e6c988e1f5b90f6d3d2837",
        "8dea4367d4e69fac366b2fb19943bab15e101196251a24a47ef8884e8ee16b45",
        "8ec6cb5895340442995a41249bd7d7fb87909f05edfb3d6d4aeed4bb5565abd4",
        "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2",
        "91f669dcf2abc70cc58c3efe37528e55c799a6a1a1795486f40529fc36af220f",
        "93641bc828d9a3a5abcfe3ffd95beca452f50cac4de17337560bbe477b1338d6",
        "949d7b0a70d9281ea0bb37fd8aa082f26cd4efcfbb376d0dccad043e772c09a0",
        "953bb06a8a1b50267709b119eee0a62f9473c0d825a30e3dcc5e1d8c71ffb5cd",
        "95aeb819f45bf6639f460cc0ba5fa250f81764324ef35320bf76fb9f99428fc1",
        "974a07489ed265563e90dec23dab88a41201a38154d535e54de18f0c2754e389",
        "97d5465462f2eceba0aa8f8ce38d8f9e7987e238f6fadb61dbe4f34b3a49029c",
        "98bfde7e1d71f4d04b86d75bc40a7973699e1c8b0d3c9b8bc4bc803e0eb42bd8",
        "9b6bdce565938d055a79ed38791aaa2b0279747e1449154ab2176df1af0b9e36",
        "9e5b44494ae7673b29986a4209c04f171fc6fc8703f2defcd96ad19a903740dd",
        "9f0113a0aaa7eb6a56e72e338a52acdd1d7cdd137c31a562f958a9b1e20db3f7",
        "9f3f13162cd203aaed4c903c3973b9c7156b7f7ed28f126fb5bd23e2c5052c9b",
        "a00cc241013309916c103a1c6815bb4e8659086bd5516e95eef3ba95138419bb",
        "a0936e8c41d35eed420f7cc9ecb7fe058bbb14816da383b3e94972fc38f56f3a",
        "a1c7f645cffefe87044182163d1ba815a209028cdb538bf1c58be490a793058d",
        "a23eaa305c4861f666aa7529a19d577d124327408062d08393f380f319c7268d",
        "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1",
        "a377cb09aed8280839499f3b7e46ee0e405e88fbb0bf4568c8e74d1830329162",
        "a508ab6b2c4155684f25e56b0cb1c6ce763740989a97070b0d4b800c66a8c148",
        "a6bb14c90b07b937c1f9a00bd7f0cdbeb76beb1230d6190387d3e390e5e8eabe",
        "a89ac1ab001611a36b77cc616fea47adec633d28a1b4d5acc15fd486536db2c0",
        "a902b2f4147b828f2ea1af2e8a7502b1ddb9aa69eca147865128cacda7b4db68",
        "a96310c0126886e41d533f45005d1a2f38ac925a3bfaef1a8130b81d073307d0",
        "aa75d54e4fbfdf0a9492e3f5d4ad1f93867a5fdd23c216c603d22461524ce1ce",
        "ab6c7cdf1f7b3def5e451d569d2a14464fc3d96c9bf7bf0329d13f6a95dab28e",
        "ac164c60817349dc341fb503710f678c9f8afc5af87c7534931cf1bcd6e31e13",
        "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c",
        "ad0f409e0f712e2ba43cad99abfd47bad7850992b9aa89a9a7507488c48c02ee",
        "af465088b7bca054fdea72f82d85efb249058e69e028e3e25c9233013bfb9abb",
        "afd43d65bfc6e5837d8e1edefd057a363e57e35f5932f6e5314cba2e7974caf5",
        "b02ab2ec38aad319cd44f912cc1081783ea14daf9d41e307fd1f2dd0ef102eb8",
        "b02c9af5affe49962a2260c2f4fed8bad20df00816abb25b73cdbf79cfd36541",
        "b0dfa528deebaa3b03e925cbdf218bcc35d0d6060bfbc749c47eaa01972287ee",
        "b1222850e65e6de7b9686061b1ff954a7fe649f35ab72c5c5b6cee3417829a23",
        "b1aa54537aae0867953d7aa0f69944a41ebb49f342e12d56984c8df6db57e49e",
        "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774",
        "b1db576b0501c5696808df9f75d6c49f526e764a8f5a6dc589439bdd50b426b0",
        "b2e239dd44927d93176ff16eae7f2c32d3c676f81adabf201281f905c0152de9",
        "b497c3f26873195e173bdab95c315b99fc8ed29e4635c01d06660bda5d35a460",
        "b4f2e10fcf987a0bac0c50bb46c37e2c5fc14c9c52ab5103b2b457cbd4a4f971",
        "b519bfdc78b9b33c5ad1ec06de08641045aa71bfb240b39aee4399054a291332",
        "b6b17b064450fa44c4389448c37af964ba521c795bccc491047c502e605a5109",
        "b7a1aff2aab405303807daad7c767d0184af96a6749dbfb42f130cc7cf9439e0",
        "b7db22a0dea02cc49cd683ab16a0d08bcddf1aa75e35074b31bfdf07f31b7a41",
        "b8b361887915b54e5254081a5b44256e0eca4661009eaf88d2a10b9b4d03711d",
        "b8bdb3434ca81f3e0a6e88232bc0fe3c250076ab60dbe22ce7ed57503ec8dc81",
        "b92c7890c20ca6077752d1d41533a6d7b006534d2c091ebf4aa05a032352eacb",
        "b9e64b7e22325be5132588238314996d7d12aee1b6eb9a5b1fb7f93dfb158166",
        "ba05f882af856903df4433143f2fc167a9278c15c26f19c5f1c6d289ccccdc75",
        "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd",
        "bbc50b9d7ac587045b37b27d23fcb1e10bafd66bd4db91d857818727213b1ab2",
        "bc2250b3bbd0f2e228e5c0ae8b5b3b7673eaa17ace54c84d91694074ba7223d8",
        "bc5c76f4105271ebebe7a9194163ce816b427d4d2f181b45f10df48bc4b0603f",
        "bdce809ad53e383b996aabb3e61ea8d0686fc3de251cc48967d4c2d8444588b7",
        "be3647d40160c87594b0a620259079d9584855c2c96d7d1aa71b411be4670d77",
        "be9aa6fa4b29035824ada85f30510fea177db7c5ce246785bfddea54b38b2797",
        "bec6edb73cb7a348678caf43c5d0dabb969af95b6306f52425f600ebdc75cf4e",
        "bff5801e15482ae18503c8162d0824ac3ee7b8ef0c0b279de648c76d2ec0b067",
        "c33eee75fe728568ac53586d15640af621393ce28e18d32d292e0089e8d2a3e8",
        "c473630beccd7541edd4e7e39518602b0c803a6b922a1c995c89e9b6117a2410",
        "c5532c7bfbca209bf9e26cbe7c53cd6e5600e8697a71e168484ece9cca7376a9",
        "c5ba270ef8e5698ec8acc5ef998d25cfc1eaf5b14d22bef7c5d487ec5694f7e4",
        "c64aee8e735bec4b400d9927bb187102c9d3c1d743c158cbe875acac153459b6",
        "c64d2d6d4005dca53fc4a08f0a3bbe3208e72019ef2a0193793f1d4663006b20",
        "c95a39a052d4b8868904d1560c21d1a1204b61ccf65f1947e53eeae3a0ab48ec",
        "cc1066a0116612367cc7dbd153ceafb33a339a37e8d2a0eb452ef21666d5125a",
        "cc4f50713740fa90b970158c67f551cd8192bffcce60756fc56d67e3bdac54ae",
        "cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778",
        "cd14e476d63f09ea56c79c8ac8f1dc0b412bfad6128ec5f989ae6609da9d9787",
        "cdec3d8785691f5a20dc21aadf8292c03de8a99883c70a4a293c6525c8391ace",
        "ce63fdc2391f8371e83078468c0f765b95d366d9cca6559dc7aa0bae74087080",
        "cf792a72d1b2fad347599005405563293c7df139b0a1d8bd86cbb2b85ccba07d",
        "d046f4358f58251113e22c952a268ba92460ec7f3766fe54bc3490b328228808",
        "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960",
        "d1d004ef6cab71eff1c4ce2a6279a72c80cbb818a5e83793a02768c02f333cb1",
        "d49c7efcec35207a50d73d6ece15f210836f7f96f95a80b6a3a69c8e69e07b73",
        "d56e5aebabd58863d2bcc7ee755e49455276d90b0753812f6b7a32cece7b2bf4",
        "d7178a37052f6edaec8c900f6f3cd0c7153616e71c07040f4d9b15655a1489db",
        "d77387230c64cc9ca79621b6dd8d79c2be74116ecf1309d24a4daad8830461df",
        "d86635f3a44f9f40e3674160364d3f4003ce8d0605db6d6c16a7a3834a718460",
        "d881253c9957342cb3aa37bbab00c2a366520facf938b776e101fab1eecd9e51",
        "d908c0fb5695c570760039df29fac0a19338793b9a208f87391c555d75f6b591",
        "da2e4b6b9d67b2d582287394001d24c7a024b09a22441183b77c06266ef8cd1a",
        "da971e566960305be458f4558c1fa0539c41bc8a8bf2fde5b78f4214b0bc4dfa",
        "da98365b84a197536910a405575834e5c190c501798eb924683491ed4920d71d",
        "ddb69875b352d23b037c3d9e60e37be4079c8a7b833be2b711d7ed444a7a1eca",
        "de8dfe96b12766a25af7dfd6002dfd01a05f1cbab72403565555a18f7827f91d",
        "df038e48ae1cf00df980e1695c5d24e33a5def4e83c8847c47ee8ad6b9c29f61",
        "df7ca759113219a47ab1137e1173926b980e39846a08f412b063964db45baf2f",
        "df929a19686ffe51fb53183aaffa16c4850b7152f630294cea211db8b6d9ce6e",
        "dfd69f8ae9bf11237ff75a8a99228016a42095c668945fa784475f71d13a1055",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "e1b8b232390602806a3459ceabe220bc4c82722573aeb71906cb200395501162",
        "e2025247d4da988cc38550f9a152e9215ffb8ff075fdaa6295aee88a0c091c17",
        "e294003090bcb1c9c2033b9ad263da6bfbcf0a154d5c8e2dc2d80b5b3ee0fcf5",
        "e361bbf0cebd428345e32e8d6cfc2ab0b7615cfefd26e5d7298ba8b180fe03f8",
        "e541074adeea07f2e744b585e0bad89088083741686c35754070b606964a79a1",
        "e6197f38c851119f5181c7469808dc2b7da8535e3553671d1866345bd8496a6b",
        "e7174d95c6b97ebff236cf453e4782db958a1485f46e12ca3ab70491bcdf2386",
        "e7176ea6fb432254390c7514368921c3fa842a4239bc110967d15408af4e4948",
        "e77421eb6b03d9fea4e8c2dfe7f295d8c3e12dc5e84dc909339b191a8ed23f21",
        "e8c65ec4c8b0b5641fb5f00ffee35d10caa084fdab4a3650a21a7367e5b07f6d",
        "e8e97d43dca628c7d371a904378e5364ca62240c2dd6733e818f197180cbd2b7",
        "e9004779fd94929c253c40235c3c24c07f92467f2d376b936ad713d57d2cffc5",
        "e9bc717155c239636ffd56b69f2a4265b2dae6ce9297451a86244dc6d8b963bb",
        "e9efbbfe4f0977ace539655802b4b0bb35904ec30d2c16f96e40f60258bf5fad",
        "eaabcd104bd41a84a849a62f19d519ad6ba2487f0fb4df3ece279482a08b40e2",
        "eaff84de3e8babeef0485043e8b46a9729c44ec66c441c578b949cd611dd00c7",
        "eb0202810be9e68bbf9b6e4441f24f467e7aaabcf84fe369231b45142c6c3200",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb",
        "f1d9ceb280860e62463de4785c7e31ac095993b7ac318ebff39c31312a49d38c",
        "f1f696ca81b66edfc301918f96e7a8d1c90b039a6764127ecb97140cc16f6bce",
        "f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624",
        "f2bdb29b2ab759eb7507d892df8bc31387de19fc69c6f2ac7cbf7ffc6fea71e2",
        "f2f59cbe97ce5d5338b4e01f325b004c6757bfc21e5a81a4f6ef3d9a50c30615",
        "f30e53fa65a64788999cfc9989c9dc100f9f446ab1f4f8a74437a861651aeaa9",
        "f54aea8c6780d721f15f7fbba3a90092b4cf45a0f10dfcc340a7f3736c726366",
        "f5f0b4e52886ede43fcdc192c333cc97230f1cf0ce8ff3861a4ae72ba84da940",
        "f7a4f4d5c1dfc58a82597681da045a8b489694193a9a47b9ae96787f2bfe008a",
        "f7b499ba073511bf7358ed6fc6fde8f250896c4d47fda7a24141b1e224d4729c",
        "f7ebe93db23315828ad6f208364b28095f1b5489508535fb1861d9424060dcb5",
        "f8d88551353b5d177105543724cc494a67e4a79321866603a2f8678998617732",
        "f93c56378922be01d12d47c3b9cf120d7b5d74d655bd651acaf29fa0ca966afe",
        "fce2c0a091ce61bbc2f936a9d7071a218c2554767339d0f6836c6fc6673de55a",
        "fd8c61dd75e9605cfdbb715caccce323ef6de674dcd8652747383d679d2bb78d",
        "fe1bac01ae90041af077561c48bc727799fc9e338d44210bd63fe3ac3ee3ef96",
        "fe767d0966c5eac96baf80580141c052a817e2b7a444fe35aeae326ecdcc579a",
        "ff8476765b55fa30df0ff407dceefbd784551737ba5d9380a25ff5f20b81fe13",
        "ffc9e9884a6e78ac2a3e0b8763e7d5c5b5ae8f9749d3cd5bb5a354f8e2190ce1",
    ),
    "GPL-3.0": (
        "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3",
        "0774eec9ee5c7aad01701570c32646522d32b5f69613ff7c784593aa48570cec",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "2758fa9ef17f491770d0ea1cce1b0582e2d5d0b24166c20584f5c29123eeb836",
        "2df536360b31c5133bd815f1c033ee5acc0b0a6d6e3191847b48ef3d3bd5f528",
        "4054fe9e5555a183263a69ba1d67b3944db2302a021a82f87a71a2daaa54f96b",
        "41547f4d5df9adbabe2edd1a6edd613e9503303e6152da1a87b73b644df8df68",
        "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19",
        "5b676f111f9f31ef70b17710ecf501ef54599f0fa80d29121cca0b1d19210ccf",
        "615f9856b13cd21d3c20a766c752635ad608e8ab57db5f9333786293f3d22e69",
        "a300cd8357896ff5d895d6c47aa10de6d70ac67ff261d33e5c101eff7dafd3ba",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64",
        "c9fb4e3d004bc102566bdf863e547a7066b1af9568614e4b3dd5c7b254071dc5",
        "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2",
        "d01e8e0812c9d64a43421cd0215917d96dcaa82af1a2f898034b2d11b6b09e69",
        "da499c184dadfc8df8e73a1c134543c869b82ca0eadc1c033cd6cad0bc964858",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
        "ebebfce2b9d13adc3182f9cc45912cc2ee8c9e0444b88cc2be304cf520299845",
    ),
    "LGPL-2.0": (
        "005bda94da7bcbb42b2c842ae3d58418c3a819891261b50e68ee2973a80c11fd",
        "07d2d80a87aec933ecf5a176fbea5e5427abb61db8822b2e934f6b861c5dc484",
        "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2",
        "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d",
        "0cd5ad5ea5fb03b32dc2af2285c79971a1a233830dd7cd98360d456dd4783759",
        "18cbddec1e6306f0e86f0d06702d5e65283d580e6d2b8235ca088ab12d4a44ce",
        "21e37855feb6c56b43dda07d6a9bf8b3b82bc711a12951fd7edc2bb980b3fe29",
        "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323",
        "298759fc9b28a48e4d94b51ec996ad29ff57a0b5800eb1cf11750e2d4afc636b",
        "2ef15d944b8233e85c7041d3d560b65a624b43daad1faf72e1bfd3f5844b1b03",
        "346b4b56ee25a5058a9bafa545d3e568c301c5c396c60065e10508e82ad64cf7",
        "36416c2954e67dc49f0de1dd844c2de2c23b8e6fae5406ddcf41b37fa1438892",
        "36b7a22c8c5b0b07bc7e3aafd3ee2292df3ab0239ddb4ce07b7ed7ef88468a64",
        "37fe41bdc706a9d330454293e89edd7bb1942b127ab3e33a95d18ac0ea28a4b7",
        "38681946407696fc7ca2ef05a88b3cf3443c332768ca2f2427c2dca5d45fb66c",
        "39fa2e711f0eecedba51b68d93f223821dd02facbe28be1a0ba5afdf08106076",
        "3be81584f9918f3b14ffec1a1956bb1d3186a888c4ec08bf8469d6ada33c077d",
        "3c18b58086a40da88fde7730664e6e95a009c2fc962abb318d0e2469bf90733f",
        "3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6",
        "3df2c3f923ed90dc8edd6e330a5e416e2f102613ff00f415816007c48a1a7106",
        "40e1e6ef14eddc03760301819a63fa82ecc44ba2b43b430c1b9b7f51e5454175",
        "4267d994f8c02ca4ef8e1b0ff4cbc23bbd6e3a92e635af26765abcc108701db7",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "4401e0261a8caf4fd55eeb0e816fda06bbc9e4b2605767f5ffdf843a5c70e07e",
        "490cbd93d9c1f82b8a91be4d1af65b6ee477a31b0cf2b25af74d0417bd941071",
        "49a930ae03864d02af72229d9849a28b3bdb7d5514526e502c30862791795300",
        "4a1952be6da8ee1e4a40374273620588e32bc615de632b7b1b7893ea51124cda",
        "4cf13891206baa4e7ccb81dcc4eae09b1c55eb6861298f7a5b2857baf0bd0f7b",
        "4ed7ee4d33f7dc376f7d218368e301b21dc31fee62f8d91352bf479d05a66ad1",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "51ef2b606b9824aa234c119a731531cf121a51b5df42204a1a1236382b2f95ed",
        "542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63",
        "55a8736402513c4bce16ada7d1b2f020dbc1ad3686bb6e563d1eb2e042870c0d",
        "57fcfc4adccd6504a0d5081cf0da07333460261a4f835b02503a092a017207bc",
        "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b",
        "5debf5a6c5f4a3aa2b46d4b492c8fc91753cb61c2933eb25d8b8e62f539cbc4a",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "61cbce1ad10d3b01d130a67aa9d339b8e0f260e773fe0383e51c1d9022ce9ede",
        "68d0c9820932cda737a0abff805ad2eaf54f79868f901ad919316947d75ed315",
        "6a530ea2f5730a8586af0f0bdf726bcfdd2e473c22b8061698c9e161decd696f",
        "6a9cd9559ac26251708659b5b820e12e829acaf5c0bea07634da7da8aef67952",
        "6bcf4fae5fac3aedfa4dccf6248ea48bfd1ee53edd8f1191a4970c156e10141f",
        "6c3bb51c96b2900754a1c65123677aa74c9ec1548193a3d0bac6240c6847f8f8",
        "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f",
        "736aa88e50cf3c3ea93c80a3b9a349833dd1b381c6a9c336770f2c61822e164a",
        "737725713ce1bc043b456db251ef38d2e9a28a7033b47d1fc7b5a7eb47feb0d8",
        "73dbe68688642ea8753271a313d85ca880b4dc28379e1b21b2615f96758c5210",
        "75b8db8751dda86f43da92c773c57c485e69e906a0617521627e672c56bb280e",
        "79917e1303d8e880f93cbf55b87740fb19dd9b1183086aad42d72e12247cac8e",
        "7fec328e00ff3eca2f3cdded990a7362ae32c1e68c45891eb0ea64a5bcbba169",
        "8100f96b53665718530110c38c26d5e602fdb1c5efd34a7951470e407b5b13bf",
        "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688",
        "8ae5d92d44f688fa76ecb95d097b1ab01d695d6ff7aa46ba4b02be3572283db9",
        "8d41c7f6ef85f76da75aed0552ead9560fea25049d85413f12392e4df4ee0c16",
        "8e44ded3ae43a8c169abf24cdedede09b343fc7843942330e60bb0685b58f80f",
        "8eb87ce49af8ea4a3c1de537360a5d0e3eab105467bfa16ad9d8544e8b0feaf0",
        "90528b4d0c5da30cbaa38d12cb410c377fa6cbc2e331b3dd6764e84e6606562f",
        "936eb024285b788f0eddbf96826d70da1adefa3099b0ec5336ffe495c00b7798",
        "942b4956046fc02caa19208f4e0e4dbf5c62764af07851938c4211912ed98c10",
        "947031dd5dba479ef1d0af61ac495c6299723ed664f3df3997367a1ef3d17ff5",
        "96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0",
        "9ad20dc65099382ecbef92bc367f3a8c15bad6d5fd00319bc94ed109c3368f0e",
        "9be68e9f0018885aa7b6b15e4e221bca8271a817b743a4bed7fa33fb38f47369",
        "9e5bf4265f08b728bd9e49677b174ebfa4c35c8c6e841f29755e9c81caeff2d5",
        "a4357426383ca8bfc5be4766a449e994bafff9b6add7b3db818c46815a969c6a",
        "a786cb3f3940864cd6d637ee550243e5f0347936515aa1163e814b8c796ece53",
        "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c",
        "ab47c0499d7721f46d460d9c8e38a450e7a21dc7691765af7bd76d83ef3d4c32",
        "ac5d4f0a2e7f79c9b968056f3048edfa838562cfea06b6d44ed2143685d30e12",
        "ad81fc738f377aeba41fc24738c2e644becc9d2b6dc33ae94d1d1b9c5658fdd8",
        "bb2c7aa8887366323df54f6963ccb392f10912344a7706ae0f0e2ffa6e3820d6",
        "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31",
        "bf27b4f0d740bfb6930354a953a2ba4314169be6ddee2989c7aa20c0188878e8",
        "c3f3d9102165787a023b6e500c552c44d8b869e0fccf8ec58dda3abcfaedd141",
        "c6df18542cf303c3e410904bb2e0e4b75d50af1aad0355f487b92ed39b5666a0",
        "cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e",
        "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318",
        "cd0909403712694c9ea18a84f7dbb5d566c041db3dbd0e334cd930c31dfea7df",
        "cdab840ec4d09c60fe663ef2fe0cd2c29dc10350b99977a6af35fa94814c11de",
        "ceb2e21b3e8593eae9668fc5c72a4295fdf327bb3b4d6c837d85aabf51beb068",
        "cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319",
        "d2592336ad2f44c5dd57a1e62477de1a82773dbef4870325cbe6ea8a5137c0f9",
        "d3c450c8613c0e4ca61a8ac303ece1b857103e889020560d7528621e239b51ab",
        "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108",
        "d6ef0358155ba2bbfe03a0ad7bd0c8f55b38c0b2d8a92c13bacb4a3631a294fa",
        "d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef",
        "dad342cb7054237ec93c6a9fb9a2b04a74d49b706a831e26399f7b1182720ae5",
        "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1",
        "e3486a0000bbe009f718d654729c9fbce91815811f5429e302cbc6cf9f016320",
        "e65630f33f7e8e0deabd7ad9cba96d1475b354406f242d2a1848b0785248e71e",
        "e722a48a269f88d5d26a630a9e1cdfd4495c01505fe8703f6e6748b4f092828f",
        "ea3fd7ffdcdd305b754e35c3a9e04c04f34a2862b0b83ce82c2b93c956f628c6",
        "eb2e5731997d381fd2955790835b2fac4e07939c40e2e0a575c7bafbb66c5bba",
        "ec51741b93afb7a796a140948c156852387bde23b18d007c114dc0ebe5e03e86",
        "ec86ffb645bd34243e393aeb17a5100bd4b2c718ebf3a5bf9e773348c6689e9a",
        "efe55a938a61c4a37a0586d48a0ba7d2dd994fb2c79982bf1a38c2d6d2635a80",
        "f0daec6a0f573603d63948a57e952939050886941e593ad62f992f20e0a12443",
        "f6f787a756b0ee346078680aaf1b61890be68459d8177b6c3193d90b16ffbfd5",
        "fd6ecd690383195cedc0ac953ea966c35d48d76a0c04c6bd8f81bb4fc1534b80",
        "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380",
    ),
    "LGPL-2.1": (
        "081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c",
        "08282405304cad17b40cba825df10b6dafc48a882a1d5e133c36994077ff3c50",
        "08bbec296af573d48346c1551eeaa919f0148904286bb4a62508f881396bb7ad",
        "0ada2b97434877c35647c3a5fa0e326368c914c55a60a692533f191ce9a2e93f",
        "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87",
        "0e70bde79a72ea6071aa23f735a8c6c99f8eb3c22ddd65279dc2aa8f01a312d1",
        "0f06897134b6f557ebdc162c6fd438c76ada31075216c3fd964bb198098665d8",
        "0f1d293eefbe65cfb007535e5cd1dea01fe6ef6a11b6da1e4bc51f3e4600df45",
        "1246388d7683386b80d5bc3d760284895b628490f9a4e36d56f9e2ff0337dd8f",
        "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd",
        "16ab93e469eec2c225b320503b4c486f5caa7ffc5124d05d432fa02a222cb99e",
        "19fc4e6af7a00c932e4783857ac9feb3df9eebbae0ad3d2e4d3addc5101b7c16",
        "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4",
        "20136473d72f8fa2c8e3998adda1cf5676c9bac2bb48f059ee804302841a5fb5",
        "2267d7a16c762c19addafa5907242124b02ee1d98f3fcbb21e8cfffd07032f62",
        "22c89dcbeb088cc272f59d1d0185b01e571f6eeb4c677b6ebe683a355ea92717",
        "28652d4cf3dbce632e7c0000e2503fd751517e924126c33b92dfea0a874f7c81",
        "2d337f9dda653ce2747a8762ae5cbcae8a2cd1f84d55e19f362301836ccfb191",
        "34d71efafedd8b2ec1c511c78c4d6d5556dd9f0ad84965227ea740a8b1a19120",
        "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169",
        "3c9cb6019e9c237684902c2e3cb2be819be4d5c845e880f1418c6512cbd98725",
        "3e9a70c199209facf3116dae5197678bbf9c0192fdae0b9a3ad2926ae1068de9",
        "4138e55db7803dc70f5498084f050e0874c22ab68348f1d15648ab8e5dde2a82",
        "41de8df01c074b8c37b3ebf5af005a998a42ae91a98a491ba9a15c1d409bd915",
        "43dcffee22c390fba40e4ae275d51525e2f36711ea893eb7c531fb2ba4c88196",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "48e731def9111ee21e7b6b5dca5cb8e908fe999f7c1ef9175afef1e4c8a5e26a",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800",
        "5138ca4c45d15ee994b636e60fd5534d7cd13d69e59562c9c74f8c87a19b32b3",
        "54267beb181625173a53f996aa0ebb209a5dac7b82d1f8d12dd00224ca89e741",
        "580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957",
        "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa",
        "5b96a99ffb36dac6535fdaaaa41662c627ccdde57e2ce79c7d05d07977487add",
        "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0",
        "5dfda13a59b94615faa90177a8342037edcc684db4edd630ea3685178f5d2e1f",
        "6108b77d9eb6799734a40ecb5bc901c43cb250a251331ef6ba2a01ca390ab2d5",
        "62470f8c7f6c88c1c89d5e4080fc0969a43f31055e91336c089eb0ad2152027b",
        "63a9e54a9c20816b2c240f12cda2ee7d6c9f2bfb426b706197a99f75ada62c9a",
        "66eba6a3269fa46e0d45df438c0597f019cf9ee220ad4cdb37394484bd13b088",
        "67cbe3d9cde32d4b753be7e7e3df91788805606d7a3d154914ca1673f19e9c33",
        "6bdf7bc46c73e8190510b5122002bc57417ea79393c03a7a45fcb95542e09aba",
        "6ffebb9ba13257ec9a883bda3ca2aa3fad26e2f803622c0ac88cde34a6c046d6",
        "71eee136490270d69b21a1a61fd8ab4eacda17317db7aec1ea145e796cb71021",
        "72857bd13ada5f0a4fa9cf170312a75541329ba559d84ebd0bdecaf34326b6ac",
        "75fd50abdf9b6ede6e1241986dd3e5850aa7c83b83892f5bce9e206765724836",
        "77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5",
        "7b62869c73212fad565a75c9e77a132bc0f89c67f22cb58cd98c66d7cd71e089",
        "7cc1b31b95dd0bec1ff475bffceda6889681862c0b7d0da58cf97d3ae0a5d4bf",
        "7d067fa87a3246ee4fe6c45ceedae65adedaa300f6293e76e285bfd7d08acaf6",
        "7d7f57b60f2f945c171535df851acffa737c43ede523986b2447155c183e8ba4",
        "7ecbc9551902b96bd16e868212c485b6f84d52b46bc019a9f5316cebd4ebe39f",
        "807e974cc8177bdecb53682df4ff8d2bd7184fd8e000fb80fc378c865fdcc0e4",
        "85d6364ae4e814a81428aab6e5ce109339f31be005d685f9585b35ac19d730e0",
        "88e186406a818ba5d97097b346fdc69d42904154a4006622c18647cd8a3b3f5b",
        "89f259843a60ea687fa094bf6b3052ebe23487780129ea63b2bd1fcc5ebc47f6",
        "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb",
        "98c3badd328e41935b497c104ec34622a1957d223c842d26a1838cdb1d70b452",
        "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4",
        "9f9fd33522ffbd0329f54a6e7a6f541dce30fb92b4e7a7271e2b62d933237880",
        "a19848dd8a66913e5880ee7b53afe86b97c83c8b7dc01d8d696b8376c4784067",
        "a410900e6983c792f42e2267911d7570e409cfb8af0c9125ef02a022229ab14d",
        "a4971b905a26ac9ca2a6dd9ab0c50275463412ea028625d1622f7a3733c17583",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
        "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa",
        "ab682aaee683727453d8495c5d8feb7a103287c013c93d3318f1535e45d55aaf",
        "aef8deef7d002f84e6a80926924f1660e17b713ff3907f5e8c42f89e126725c9",
        "b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e",
        "b3de6e6f4377549f6ee2b737203403c9e0e029d49f0433e62a4ab6ee7a5329f2",
        "b4ff603a9386ef10441480c506710d0a91784f3473be85b32d4d37000144bf26",
        "b6948d8bf446092e468c674e7306318b556420b6e52f3dfcfac29442086d1ade",
        "b98703eb587c8bee15df46d77493e482bd6e7be52237846d0ac579422022b771",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "c313f62d3d2d77416f54907be285018d67f9ffe43b6d2617bec4618b38146bdd",
        "c647036ad157c8987d171d383b1ad3eb5047e66a5f96e69d8af7184ed7172b44",
        "c82a2bcbe458b38243e0fbbaa5a3a1faed4c73882695aafefb6ee4e8165d531a",
        "c8fae5db108dabbbc956999e303eb6502293269b94bdf2932fae0427f7fda772",
        "c9369494bc3c8d01995b30224c6aa0af52dd5fcb01230fbedb398a6d454a03bd",
        "ccad21fb23fc8880998e53f3825a609f23277b4fd122a416498afb2797c8cddd",
        "cfef84e2ac958903c9f0195cde26c8d7e7a1f53c1ee6cdc18d44e6196ef1d105",
        "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2",
        "d534c64aa234c4628a102cfb601ce508e27911bb0d4faf3d3ce71ce6c3537e73",
        "d7d0cf75d55e6c999d42344b8a11a7e2f823ad687bb88e37e8db1b650fa0a8c6",
        "dcf2d509155c3572e706bbdc7b21802938ebf1b924403b7e73d8c8a43d930206",
        "dd2b36e486ae60cfe4e8b5c7782ba639fad1551f8abeb655fdd26440824b16ee",
        "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421",
        "e5e29758e44e3782a2b77a3940a135afd88573d6c6a9e5864e06c86488ecacb8",
        "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b",
        "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9",
        "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f",
        "ef43fdf4b3e7b870eb7f3029dc9fe1b44f543bd23aae7552f91fcc552dd83b3e",
        "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e",
        "f1e897af81e75c86aa8fb3e65c0bf04e6d34a846d618744a43a37157c1b4aad7",
        "f652e8f587e933170306e2caefac2bbd9c1ed90c52868bbe210a94a2a91f2d0a",
        "f7d9b1c322b61fde1da0163dff6fa6c306210c2c5a96e246889b584a966a31e8",
        "f8d69e17c32c1b3cc0da8dbb7465203599f7f1beb3ef6f3590ce8fdce9250040",
        "fc0d4ba14f67d8e26e065bb4efeb4edf3f0572e22db6c165bde59786dcaf922a",
        "fde9bfa493e6c8404422280883a1269d28d0d98404107bcf07b2e0e120944ac5",
        "fe1e4e79e75a761f9e18e6c55697cba51fe044489eb12d24fd4231b83ef47132",
    ),
    "LGPL-3.0": (
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
        "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf",
        "721896e8090220f2909b0178374f1db7363ed7c1d8ec2c01c5f17a3ca7654a71",
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de",
        "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6",
        "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979",
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
        "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3",
        "f29410a4b9cf7ada059b5029550f39fe3cbfc5504fdab2a0b727735754430394",
    ),
}
