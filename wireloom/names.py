"""Namespaces and types that the operators share."""

# Namespaces of the vocabularies.
ATOM = "http://www.w3.org/2005/Atom"
ATOM_03 = "http://purl.org/atom/ns#"
ATOM_SPACES = (ATOM, "https://www.w3.org/2005/Atom", ATOM_03)
RSS_1 = "http://purl.org/rss/1.0/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
DC = "http://purl.org/dc/elements/1.1/"
DC_TERMS = "http://purl.org/dc/terms/"
CONTENT = "http://purl.org/rss/1.0/modules/content/"
TAXONOMY = "http://purl.org/rss/1.0/modules/taxonomy/"
MEDIA = "http://search.yahoo.com/mrss/"
MVCB = "http://webns.net/mvcb/"
XML = "http://www.w3.org/XML/1998/namespace"

#: A node of a channel or an entry. up: its parent's tag; nth: its place among the siblings of its tag; whole: its markup, for
#: contents that are markup; parent: its parent's i, -1 for the channel or entry itself.
NODE = "struct<i:int,parent:int,depth:int,nth:int,up:string,tag:string,local:string,text:string,attrs:map<string,string>,whole:string>"
PART = f"struct<attrs:map<string,string>,nodes:array<{NODE}>>"
ERROR = "struct<class:string,message:string>"
SHREDDED = f"feed_type string, atom_ns string, has_media boolean, channel {PART}, items array<{PART}>, error {ERROR}"

LINK = "struct<rel:string,type:string,href:string,title:string>"
TAG = "struct<term:string,scheme:string,label:string>"
TEXT_DETAIL = "struct<type:string,language:string,base:string,value:string>"
MEDIA_ITEM = "struct<url:string,type:string,medium:string,width:bigint,height:bigint,title:string,text:string,description:string,credit:string,credit_scheme:string,thumbnail_url:string>"
ENCLOSURE = "struct<url:string,type:string,length:bigint>"


def q(space: str, name: str) -> str:
    """A name in a namespace, as tags are written."""
    return f"{{{space}}}{name}"
