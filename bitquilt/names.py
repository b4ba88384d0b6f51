"""Names and alias tables of the domain."""

from __future__ import annotations

# --- fixed values: names must equal the published ones so that specs match ---
XFORMS = [
    "id", "hflip", "vflip", "dflip1", "dflip2",
    "rot0", "rot22", "rot45", "rot67", "rot90", "rot112", "rot135", "rot157",
    "rot202", "rot225", "rot247", "rot270", "rot292", "rot315", "rot337",
    "sft-u1", "sft-u2", "sft-u3", "sft-d1", "sft-d2", "sft-d3",
    "sft-l1", "sft-l2", "sft-l3", "sft-r1", "sft-r2", "sft-r3",
    "shuffle", "shuffle1", "shuffle2", "shuffle3", "shuffle4", "shuffle5",
    "shuffle6", "shuffle7", "shuffle8", "shuffle9", "shuffle10",
    "spiral", "colswap-3-4", "colswap-2-4", "colswap-1-4", "avg2", "avg3", "avg4",
]

CHANNELS = [
    "mnist", "R", "G", "B", "Y", "YL", "AL", "AM", "AP", "RG", "RB", "GB",
    "BL", "BM", "BP", "H", "S", "C", "CL", "CM", "CP",
    "edge", "bin", "lbp", "dog", "var", "dir", "range", "lbp-rg", "lbp-rb", "lbp-gb",
]

GRAY_CHANNELS = ["mnist", "edge", "bin", "lbp", "dog", "var", "dir", "range"]

ENCODINGS = [
    "raw", "lin7", "lin", "down", "up", "mid", "log", "exp", "sig",
    "sqrt", "cbrt", "gamma", "tri", "inv-exp",
]

ENCODING_SYNONYMS = {
    "unten": "down", "oben": "up", "mitte": "mid", "exponentiell": "exp",
    "sigmoid": "sig", "logarithmisch": "log", "triangle": "tri", "invexp": "inv-exp",
}

WIDTHS = [8, 16, 32]

XFORM_ALIASES = {
    "all-basic": "id,hflip,vflip,dflip1,dflip2,rot90,rot22,rot67,rot45,spiral,colswap-3-4,colswap-2-4,colswap-1-4",
    "all-shuffle": "shuffle,shuffle1,shuffle2,shuffle3,shuffle4,shuffle5,shuffle6,shuffle7,shuffle8,shuffle9,shuffle10",
    "all-shift": "sft-u1,sft-u2,sft-u3,sft-d1,sft-d2,sft-d3,sft-l1,sft-l2,sft-l3,sft-r1,sft-r2,sft-r3",
    "shift": "sft-u1,sft-u2,sft-u3,sft-d1,sft-d2,sft-d3,sft-l1,sft-l2,sft-l3,sft-r1,sft-r2,sft-r3",
    "all-colswap": "colswap-3-4,colswap-2-4,colswap-1-4",
    "all-rot": "rot0,rot22,rot45,rot67,rot90,rot112,rot135,rot157,rot202,rot225,rot247,rot270,rot292,rot315,rot337",
    "performance": "id,hflip,rot90,rot45,spiral",
    "performance-2": "id,hflip,vflip,dflip1,dflip2,rot90,rot45,spiral",
    "augmentation": "all-basic,all-shift",
    "all": "all-basic,all-shift,all-shuffle",
    "sweep": "id,hflip,vflip,dflip1,dflip2,shuffle,spiral,colswap-3-4,colswap-2-4,colswap-1-4,avg2,avg3,avg4",
    "filter": "id,spiral,colswap-1-4,colswap-2-4,colswap-3-4,avg2,avg3,avg4",
    "filter-bv": "id,spiral,avg2,avg3,avg4",
    "sweep-fashion": "all-rot@filter-bv",
    "sweep-performance": "avg2,avg3,avg4,colswap-1-4,colswap-2-4,colswap-3-4,dflip1,dflip2,hflip,id,rot22,rot45,rot67,rot90,shuffle,spiral,vflip",
}

CHANNEL_ALIASES = {
    "y": "Y", "601": "Y", "yl": "YL", "709": "YL", "lum": "AL", "by": "AP",
    "auge": "AL,AM,AP", "grey": "Y,YL", "rgb": "R,G,B", "diff": "RG,RB,GB",
    "all-channel": "R,G,B,Y,AL,AM,AP,RG,RB,GB,BL,BM,BP,H,S,C,CL,CM,CP,edge,bin,lbp,dog,var,dir,range,lbp-rg,lbp-rb,lbp-gb",
    "sweep-cifar": "AL,AM,AP,RG,RB,GB,BL,BM,BP,H,S,C,CL,CM,CP,edge,lbp,dog,var,dir,range",
    "sweep-fashion": "mnist,edge,lbp,dog,var,dir,range",
    "sweep": "R,G,B,Y,AL,AM,AP,RG,RB,GB,BL,BM,BP,H,S,C,CL,CM,CP,edge,bin,lbp,dog,var,dir,range,lbp-rg,lbp-rb,lbp-gb",
}

ENCODING_ALIASES = {
    "ey-c": "r:up,cl:down,cm:sig,cp:sig",
    "ey-c-2": "cl:down,cm:sig,cp:sig",
    "ey-b": "g:up,bl:down,bm:sig,bp:sig",
    "ey-a": "b:up,al:down,am:sig,ap:sig",
    "ey-h": "h:down,c:exp,gb:sig",
    "ey-s": "lbp:up,dog:sig,var:exp",
    "old": "ey-b,ey-a,ey-h,ey-s",
    "ey-a-3": "al:sqrt,am:sig,ap:sig",
    "ey-b-3": "bl:gamma,bm:down,bp:sig",
    "ey-h-3": "h:down,c:gamma,gb:sig",
    "ey-s-3": "dir:tri,range:sqrt,lbp-rb:exp",
    "performance": "ey-b-3,ey-a-3,ey-h-3,ey-s-3",
    "ey-b-1": "bl:gamma,bm:lin,bp:sig",
    "ey-a-1": "al:sqrt,am:sig,ap:sig",
    "ey-h-1": "h:up,c:gamma,gb:sig",
    "ey-s-1": "dir:lin,range:gamma,lbp-rg:exp",
    "performance-1": "ey-b-1,ey-a-1,ey-h-1,ey-s-1",
    "ey-m1-b": "bl:gamma,bm:lin,bp:sig",
    "ey-m1-a": "al:sqrt,am:sig,ap:sig",
    "ey-m1-h": "h:up,c:gamma,gb:sig",
    "ey-m1-s": "dir:lin,range:gamma,lbp-rg:up",
    "performance-maj1": "ey-m1-b,ey-m1-a,ey-m1-h,ey-m1-s",
    "ey-s-2b": "lbp:gamma,dog:sig,var:exp",
    "ey-s-2c": "range:exp,var:log,dir:tri",
    "top-rgb": "r:down,g:down,b:down",
    "best-mnist": "exp,log,log",
    "latest-2": "g:down,bl:gamma,bm:sig,bp:sig,b:sqrt,al:down,am:sig,ap:sig,h:lin,c:cbrt,gb:sig",
    "sweep": "lin,down,up,mid,log,exp,sig,sqrt,cbrt,gamma,tri,inv-exp",
    "sweep-cifar": "lin,down,up,mid,log,exp,sig,sqrt,cbrt,gamma,tri,inv-exp",
    "sweep-fashion": "lin,down,up,mid,log,exp,sig,sqrt,cbrt,gamma,tri,inv-exp",
    "debug": "exp",
}

# data-set tables win over the shared one when their name is given
DATASET_ENCODING_ALIASES = {
    "mnist": {"sweep-performance": "cbrt8,exp8,inv-exp8,gamma8,log8,sqrt8", "latest": "exp"},
    "cifar": {
        "sweep-performance": "cbrt,down,exp,gamma,inv-exp,lin,log,mid,raw,sig,sqrt,tri,up",
        "ey-s-3": "dir:tri,range:sqrt,lbp-rg:cbrt",
        "ey-m1-s": "dir:lin,range:gamma,lbp-rg=up",
        "latest": "performance",
    },
}

# regular expression of the named member filter
NAMED_FILTERS = {"t1": r"\brot[0-9]+@(id|spiral|avg2|avg3|avg4):"}

# fixed-point scale of the log-odds, vote scale, and the majority thresholds
ODDS_BITS = 17
ODDS_SCALE = 1 << ODDS_BITS
VOTE_SCALE = 1 << 24
MAJORITY_THRESHOLDS = {196: 107, 256: 135, 512: 269, 1024: 540}
# --- end of fixed values ---
