"""Digests of whole licence texts: SHA-256 of the canonical form (license_scan) of the
texts in Debian's /usr/share/common-licenses and of unlicense.org, with and without what follows the end mark
of the terms; as wrapped there, with a paragraph a line, and as one line where the
canonical form differs (lines that state a copyright go, so line breaks matter)."""

#: (licence, digest)
FULL_TEXTS = [
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),  # whole, as wrapped
    ("Apache-2.0", "bb531182159142b308d308fe34391e6848d93f2a2ed991087b686ec75f9dbb1d"),  # whole, paragraphs as lines
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),  # whole, one line
    ("Apache-2.0", "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801"),  # to the end mark, as wrapped
    ("Apache-2.0", "c348fad4100086120c9a4f71602579f6f49d5ca97ae96d36cf377b10e6e79871"),  # to the end mark, paragraphs as lines
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),  # to the end mark, one line
    ("Apache-2.0", "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3"),  # before the end mark, as wrapped
    ("Apache-2.0", "c936c3be4c0e23ce771b851922c44c2c6bbb0fb8c42f59ae99cf57ebd223697c"),  # before the end mark, paragraphs as lines
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),  # before the end mark, one line
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),  # whole, as wrapped
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),  # whole, as wrapped
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),  # whole, as wrapped
    ("GFDL-1.2", "78f09476d6a64cea1df4919b86fba920c1300c4a6386f8e29e1ffe2b71261d0e"),  # whole, paragraphs as lines
    ("GFDL-1.2", "009e9c9e26987137c9ea0122b94757f136a1becdb5960160762a1b39825c2233"),  # whole, one line
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),  # whole, as wrapped
    ("GFDL-1.3", "832d5d32b34e0e82d2380449fc42f833562da417bc1a9c180db0dfb3e93786e2"),  # whole, paragraphs as lines
    ("GFDL-1.3", "1660e5283c63da358507452d2f0ef975fafaaad4bb4c79279a7cb94aa7bbcf0d"),  # whole, one line
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),  # whole, as wrapped
    ("GPL-1.0", "adf309917b39708cd31b37ee8df5a7b34ab6e9b6f96abb7eb7482dadb797c5ab"),  # whole, paragraphs as lines
    ("GPL-1.0", "84ec58f72005313cf323b858697cf6a7bdb8f7fa268bf697daf4c3cf23e070fa"),  # whole, one line
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),  # to the end mark, as wrapped
    ("GPL-1.0", "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d"),  # to the end mark, paragraphs as lines
    ("GPL-1.0", "90b42d1cf0f9ef747c945cda0a54d5bd16341c8491956c54b3f4f283efa0176a"),  # to the end mark, one line
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),  # before the end mark, as wrapped
    ("GPL-1.0", "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b"),  # before the end mark, paragraphs as lines
    ("GPL-1.0", "24bc5345819daf657c4709aebe2be24875e021dde1ced86cd813b9ae9ae62a60"),  # before the end mark, one line
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),  # whole, as wrapped
    ("GPL-2.0", "7dabb0d812bacc36bd5b108f7d463227e71257b406bd6e551ddcc59836c79331"),  # whole, paragraphs as lines
    ("GPL-2.0", "c28b22cb9f64fc3c7ecca12ffbbe2928f5610438c0aa6d38061a1ec07bf27de0"),  # whole, one line
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),  # to the end mark, as wrapped
    ("GPL-2.0", "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5"),  # to the end mark, paragraphs as lines
    ("GPL-2.0", "8607b1cff63e9a9dc468bf76327bdd0bb2d2abe09d6e8076427fd49236f46f29"),  # to the end mark, one line
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),  # before the end mark, as wrapped
    ("GPL-2.0", "c928252f428993b646c70c671425ec87aab1bc5abf42e7a179685a96469bd918"),  # before the end mark, paragraphs as lines
    ("GPL-2.0", "e1bcfaf28e42eba7ac6b0aa31f0165c8241a74641090fe675acc693f1a3e5df1"),  # before the end mark, one line
    ("GPL-3.0", "0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478"),  # whole, as wrapped
    ("GPL-3.0", "716795b339ea4b3899c864735150a4007cf8f94db8a9f6719f34cee3b2e05e7f"),  # whole, paragraphs as lines
    ("GPL-3.0", "88f0843d0c6c4d0590128ad97ca2179559c4575ed586664c49464045d628c4fa"),  # whole, one line
    ("GPL-3.0", "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e"),  # to the end mark, as wrapped
    ("GPL-3.0", "9357e482c3cf27d6d738d92d8d67424e093b504361b6b9c0154f100eb6e41c63"),  # to the end mark, paragraphs as lines
    ("GPL-3.0", "89188cc92d1976dfbfb48a612392070ed10160bdf803c097fbcdbbf7d279c6e1"),  # to the end mark, one line
    ("GPL-3.0", "dd35883083089e6d76ba8a178db431b99ae33b3d2e87dc33fa479fe6aa2ce307"),  # before the end mark, as wrapped
    ("GPL-3.0", "1c9c0b1d90e03923161d015508f4ed61def634cba175fbfc332c3f44ef492aa0"),  # before the end mark, paragraphs as lines
    ("GPL-3.0", "694bf5dc50b0b05be18d796b8b6cab7e352dd6d053a7da739d804d5ba13499fd"),  # before the end mark, one line
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),  # whole, as wrapped
    ("LGPL-2.0", "5195fb6e43f1ce60f767cadf02b64eb560e76e6f30711d9cf9ad92c6116afeb4"),  # whole, paragraphs as lines
    ("LGPL-2.0", "f1055226bc53096fe237c134dd1dffc59802574dc173385519daa747fd98db82"),  # whole, one line
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # to the end mark, as wrapped
    ("LGPL-2.0", "052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152"),  # to the end mark, paragraphs as lines
    ("LGPL-2.0", "9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be"),  # to the end mark, one line
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # before the end mark, as wrapped
    ("LGPL-2.0", "f51728eb856e51e6247d4a023256f9cb9322abe784bdb65ecb82131ef29bfcee"),  # before the end mark, paragraphs as lines
    ("LGPL-2.0", "a1d17eaee69b0acf82494ed25367a5de1fc23474406d17ff81a7b1ee484363e2"),  # before the end mark, one line
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),  # whole, as wrapped
    ("LGPL-2.1", "bb9441a8d2b6dc28bf11a75454503afc805a9f4860d257a2e488d95f047280bd"),  # whole, paragraphs as lines
    ("LGPL-2.1", "0f8b2ac56f8c7896d16a288cbfb9e5004c40cf04e06fdc72a619c19d6ea31817"),  # whole, one line
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # to the end mark, as wrapped
    ("LGPL-2.1", "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b"),  # to the end mark, paragraphs as lines
    ("LGPL-2.1", "f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de"),  # to the end mark, one line
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # before the end mark, as wrapped
    ("LGPL-2.1", "98ee2ec068a51049ed400919bcc9b031bd9fcb4141726f51e23b5f0196a2d37a"),  # before the end mark, paragraphs as lines
    ("LGPL-2.1", "e8ebe2513d0bd90d40bb6e894699a044e69aa9b44afada1fb47e767c3fed7f15"),  # before the end mark, one line
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # whole, as wrapped
    ("LGPL-3.0", "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8"),  # whole, paragraphs as lines
    ("LGPL-3.0", "ab1202917a49a52eb4671fc091c00933076c119053fff6e8b5849ca93d6b53b3"),  # whole, one line
    ("MPL-1.1", "c79a43890898fa82523112bbaa333007e51067add616404aa40df8240afd1f57"),  # whole, as wrapped
    ("MPL-1.1", "ad5afaa8080c7f495c5f2538cd477fb8f67f9588c5806bcb9e58be5cfa2409d8"),  # whole, paragraphs as lines
    ("MPL-1.1", "ad164cdd08feae08d94e21fea94df4f43d81588fbf2e9fe25da8af5330fc1d63"),  # whole, one line
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),  # whole, as wrapped
    ("MPL-2.0", "d93233202a0668a0f31517049a3528a401f8f1f11163fb748b48624e00a39a1c"),  # whole, paragraphs as lines
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),  # whole, one line
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),  # whole, as wrapped
]
